"""What the rules find in ``fixtures.TEXTS``: (doc_id, code, severity, start, end, line, col, suggestion, applicability), read through by hand."""

from __future__ import annotations

FINDINGS: list[tuple] = [
    (1, 'NB306', 'warning', 0, 7, 1, 1, 'The', 'replace'),
    (1, 'NB401', 'info', 21, 32, 1, 22, 'many, some', 'replace'),
    (1, 'NB302', 'info', 44, 58, 1, 45, None, 'advisory'),
    (1, 'NB307', 'warning', 73, 84, 1, 74, 'unique', 'replace'),
    (1, 'NB510', 'info', 73, 77, 1, 74, '', 'replace'),
    (1, 'NB308', 'warning', 86, 95, 1, 87, 'cut it', 'rewrite'),
    (1, 'NB303', 'info', 110, 117, 1, 111, 'cut the hedge and keep the claim', 'rewrite'),
    (2, 'NB501', 'warning', 0, 20, 1, 1, None, 'advisory'),
    (2, 'NB501', 'warning', 32, 49, 1, 33, None, 'advisory'),
    (2, 'NB509', 'warning', 32, 109, 1, 33, None, 'advisory'),
    (2, 'NB520', 'warning', 60, 77, 1, 61, 'could', 'replace'),
    (2, 'NB515', 'info', 98, 108, 1, 99, 'well known', 'replace'),
    (2, 'NB511', 'info', 117, 151, 1, 118, None, 'advisory'),
    (2, 'NB523', 'info', 153, 189, 1, 154, None, 'advisory'),
    (3, 'NB514', 'info', 2, 23, 1, 3, None, 'advisory'),
    (3, 'NB524', 'info', 28, 44, 3, 4, None, 'advisory'),
    (3, 'NB313', 'info', 43, 44, 3, 19, '', 'replace'),
    (3, 'NB312', 'warning', 47, 57, 5, 2, "say in the link's words where it goes", 'rewrite'),
    (3, 'NB311', 'info', 71, 81, 5, 26, None, 'advisory'),
    (3, 'NB512', 'info', 83, 153, 7, 1, None, 'advisory'),
    (3, 'NB521', 'warning', 83, 86, 7, 1, None, 'advisory'),
    (3, 'NB521', 'warning', 108, 111, 9, 1, None, 'advisory'),
    (3, 'NB521', 'warning', 132, 135, 11, 1, None, 'advisory'),
    (3, 'NB516', 'info', 157, 167, 13, 3, None, 'advisory'),
    (4, 'NB509', 'info', 0, 23, 1, 1, None, 'advisory'),
    (4, 'NB512', 'info', 0, 23, 1, 1, None, 'advisory'),
    (4, 'NB502', 'warning', 24, 29, 1, 25, 'Examine, Dig into', 'replace'),
    (4, 'NB502', 'warning', 39, 45, 1, 40, 'strong, reliable', 'replace'),
    (4, 'NB502', 'warning', 46, 54, 1, 47, 'mix, range', 'replace'),
    (4, 'NB503', 'info', 56, 73, 1, 57, None, 'advisory'),
    (4, 'NB317', 'warning', 84, 85, 1, 85, '', 'replace'),
    (4, 'NB317', 'warning', 91, 94, 1, 92, 'retype the word in a single alphabet', 'rewrite'),
    (6, 'NB501', 'info', 50, 92, 1, 51, None, 'advisory'),
    (6, 'NB506', 'warning', 109, 110, 1, 110, None, 'advisory'),
    (7, 'NB531', 'info', 0, 16, 1, 1, None, 'advisory'),
    (7, 'NB531', 'info', 27, 38, 3, 1, None, 'advisory'),
    (7, 'NB532', 'info', 69, 125, 5, 7, None, 'advisory'),
    (7, 'NB522', 'info', 127, 162, 5, 65, None, 'advisory'),
    (8, 'NB513', 'info', 15, 16, 1, 16, None, 'advisory'),
    (8, 'NB513', 'info', 21, 22, 1, 22, None, 'advisory'),
    (8, 'NB519', 'warning', 75, 82, 1, 76, None, 'advisory'),
    (8, 'NB519', 'warning', 88, 124, 1, 89, None, 'advisory'),
    (8, 'NB519', 'warning', 129, 151, 1, 130, None, 'advisory'),
    (9, 'NB311', 'info', 11, 28, 1, 12, None, 'advisory'),
    (9, 'NB306', 'warning', 29, 68, 1, 30, 'and', 'replace'),
    (9, 'NB306', 'warning', 69, 76, 1, 70, 'the', 'replace'),
    (10, 'NB512', 'info', 14, 122, 3, 3, None, 'advisory'),
    (10, 'NB401', 'info', 103, 114, 7, 1, 'Many, Some', 'replace'),
    (12, 'NB315', 'warning', 0, 9, 1, 1, 'Allowlist', 'replace'),
    (12, 'NB315', 'warning', 24, 36, 1, 25, 'primary/replica', 'replace'),
    (12, 'NB315', 'warning', 50, 62, 1, 51, 'quick check, confidence check', 'replace'),
    (12, 'NB508', 'warning', 64, 65, 1, 65, None, 'advisory'),
]
