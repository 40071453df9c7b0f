"""Patterns of the rules that are regular expressions. English; word edges are written out."""

from __future__ import annotations

from lectern.functions.tables import phrases
from lectern.functions.text import WS
from lectern.operators.markup import GAP, ITEM, START

L = r"(?<![\p{L}\p{N}_])"
R = r"(?![\p{L}\p{N}_])"


def opens(letters: str) -> str:
    """The start of a word with one of these first letters: most places fail on the letter, before the edge is looked at."""
    return f"(?=[{letters}{letters.upper()}]){L}"


S = f"[{WS}]"


def any_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def within(n: int, least: int = 1, barred: str = ".?!\\n") -> str:
    return f"[^{barred}]{{{least},{n}}}"


_BE_NOT = any_of("isn'?t aren'?t wasn'?t weren'?t")
_THEN = any_of("it'?s that'?s it[ ]is they'?re but").replace("[ ]", " ")
_DASH = "[,—–-]"
_DONT = "(?:doesn'?t|does not|don'?t|do not)"
_IS_NOT = "(?:it|that)(?:'?s| is)"

#: 'not X but Y' in its shapes; a match that overlaps an earlier pattern's is dropped
NEGATION = [
    rf"(?i){opens('n')}not only{R}{within(80)}?{L}but{R}",
    rf"(?i){opens('n')}not just{R}{within(80)}?{L}but{R}",
    rf"(?i){opens('it')}(?:it'?s|that'?s|this is|it is|there'?s){S}+not{R}{within(60)}?{_DASH}{S}*{_THEN}{R}",
    rf"(?i){opens('iaw')}{_BE_NOT}{R}{within(60)}?{_DASH}{S}*{_THEN}{R}",
    rf"(?i){opens('n')}no{R}{within(30, 1, '.?!,' + chr(92) + 'n')},{S}*no{R}{within(30, 1, '.?!,' + chr(92) + 'n')},{S}*(?:no|just){R}",
    rf"(?i){opens('iaw')}(?:{_BE_NOT}|is not|are not){R}{within(60, 0)}[.!]{S}+(?:the|its|it'?s){S}+{any_of('real actual true')}{R}",
    rf"(?i){opens('it')}{_IS_NOT} not{R}{within(40)}\.{S}+{_IS_NOT} not{R}{within(40)}\.{S}+{_IS_NOT}{R}",
]
_WERE = any_of("is are was were")
NEGATION_ADVISORY = [
    rf"(?i){opens('tihs')}({'|'.join('they it that this he she these those'.split())})(?:['’](?:re|s))?(?:{S}+{_WERE})?{S}+no longer{R}{within(60)}[.!]{S}+\1(?:['’](?:re|s)|{S}+{_WERE}){R}",
    rf"(?i){opens('d')}{_DONT}{S}+(?:have to{S}+)?mean{R}{within(60)}[.!]{S}+(?:sometimes{S}+)?(?:it|that|this){S}+(?:(?:can|often|sometimes){S}+)?means?{R}",
    rf"{opens('ti')}(?:This|That|It){S}+(?:{any_of('may might can could')}{S}+)?(?i:{any_of('feels? seems? looks? sounds?')})(?!{S}+{any_of('at into through')}{R}){R}{within(40, 0, '.?!,' + chr(92) + 'n')}[.!]{S}+{within(50, 1, '.?!:' + chr(92) + 'n')}[.!]",
    rf"(?i)(?:{opens('iawb')}{any_of('is are was were becomes? became')}{R}|['’](?:s|re)){S}+(?:so much{S}+)?more than just{R}",
    rf"{opens('d')}(?:doesn['’]?t|does not|don['’]?t|do not){S}+(?:need|have){S}+to{R}{within(50, 0)}[.!]{S}+(?:Its|Their){S}+(?:real{S}+)?{any_of('job point role purpose task value')}{S}+(?:is|was){R}",
]
HEDGES = rf"(?i){opens('cmw')}{any_of('could may might would')}{S}+{any_of('potentially eventually ultimately possibly perhaps conceivably')}{R}"
ARTIFACTS = {
    "chat citation": r"citeturn[0-9][A-Za-z0-9_]*|oai_?cit[A-Za-z0-9_]*|contentReference\[oaicite:[0-9]+\]\{index=[0-9]+\}|grok_(?:render_citation_card_json|card)|\[attached_file:[0-9]+\]|ppl-ai-file-upload|\[span_[0-9]+\]|\[(?:start|end)_span\]",
    "tool address": r"(?:referrer|utm_source)=(?:copilot\.com|chatgpt\.com|claude\.ai|openai|grok\.com|perplexity\.ai)",
    "placeholder": rf"\[{any_of('Your Insert Add Enter Describe Specify Choose')}{R}[^\]\n]{{2,60}}\]|{L}[0-9]{{4}}-XX-XX{R}",
    "cutoff": r"(?i)as of my (?:latest|last) (?:training|update)|my knowledge cutoff|i (?:don'?t|do not) have access to real[- ]time",
}
EM_DASH = rf"—|(?<={S})–(?={S})|(?<=[^{WS}] )-(?= )"
EMOJI = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
CLOSER = rf"(?i),{S}+{any_of('highlighting underscoring emphasi[sz]ing reflecting showcasing symboli[sz]ing demonstrating illustrating signall?ing marking cementing solidifying reinforcing showing affirming')}{R}[^.?!\n]*"
CURLY, STRAIGHT = "[‘’“”]", "[\"']"
HEADING = r"(?<=\n|\A)#{1,6}[ \t]+[^\n]+?[ \t]*#*(?=\n|\z)"
HEADING_WORDS = tuple(phrases("heading_word"))
HYPHEN = rf"(?i){opens('iawbslfr')}{any_of('is are was were be been being seems? seemed looks? looked feels? felt stays? stayed remains? remained becomes? became')}{S}+{any_of('cross client data decision well high real long end cutting state full self user feature first second third multi non open closed')}-[a-z][a-z-]*{R}"
_BOLD = r"\*\*"
BOLD = rf"{START}{GAP}{ITEM}?{GAP}(?:{_BOLD}[^*\n]+?{_BOLD}{GAP}:|{_BOLD}[^*\n]+?:{GAP}{_BOLD})"
BOLD_PERIOD = rf"{START}{GAP}{ITEM}[ \t]+{_BOLD}[^*\n:]{{2,40}}\.{_BOLD}(?=[ \t]+[^{WS}])"
BAIT = rf"(?i)(?:\A|[.!?]{S}+)(what(?:['’]s| is| was){S}+(?:the{S}+{any_of('most best biggest worst')}|your{S}+favou?rite){R}[^?\n]{{0,80}}{L}you(?:['’](?:ve|re|d))?{S}+[a-z][^?\n]{{0,60}}\?){S}*\z"
ANAPHORA = rf"(?i){opens('mlfe')}(more|less|fewer|every|each){R}{within(30, 1, ',.;:!?' + chr(92) + 'n')},{S}*\1{R}{within(30, 1, ',.;:!?' + chr(92) + 'n')},{S}*(?:(?:and|or){S}+)?\1{R}(?:{S}+[\p{{L}}\p{{N}}_'’-]+){{1,2}}"
CONTRAST = rf"\A[^,\n]{{2,60}},{S}+not{S}+[^{WS}].*\z"
PARAGRAPH_START = rf"(?:\A|\n)[ \t]*\n[ \t]*(?=[^{WS}])|\A{S}*(?=[^{WS}])"
BOLTED = rf"(?i)\A{S}*(?:(?:and{S}+)?(?:that|this|it|which|all{S}+of{S}+this){S}+(?:reminded{S}+me|made{S}+me{S}+(?:wonder|think|realize)|got{S}+me{S}+thinking|brought{S}+to{S}+mind|took{S}+me{S}+back){R}|recently,?{S}+i{S}+(?:was{S}+)?{any_of('reading read listening listen watching watch heard saw')}{R}|speaking{S}+of{R})"
UNITY = rf"(?i){opens('mci')}(?:may|might|could){S}+{any_of('sound seem look feel')}{S}+like{R}[^.?!]*?{L}{any_of('different separate unrelated opposite two')}{R}[^.?!]*?(?:[.?!]{S}+|{S}+(?:but|yet|however){R})[^.?!]*?{L}(?:same|one{S}+(?:thing|idea|question)|all{S}+(?:about|connected|the{S}+same)){R}|{opens('i')}it(?:'?s|{S}+is){S}+all{S}+(?:about{S}+)?(?:the{S}+same|one){S}+(?:thing|idea|question){R}"
HIDDEN = "[\u200b\u200c\u200d\u2060\ufeff]"
LOOKALIKE = "[A-Za-z][\u0400-\u04ff\u0370-\u03ff][A-Za-z]|[\u0400-\u04ff][A-Za-z][\u0400-\u04ff]"
QUOTED = "|".join(f"{p[0]}[^{p}]{{1,2000}}{p[1]}" for p in ("“”", "‘’")) + '|"' + r'[^"\n]' + '{1,2000}"'
QUOTE_LINES = r"(?<=\n|\A)[ \t]*>[^\n]*(?:\n[ \t]*>[^\n]*)*"
SUPPRESS = rf"(?i)lectern:{S}*(?:ignore|disable|noqa)(?:{S}*[:=]{S}*|{S}+)?([A-Za-z0-9,{WS}]*)"
#: runs that end in -ly, with the quotes and hyphens round them
LY_RUN = r"(?<![\p{L}\p{N}_'-])[\p{L}\p{N}_'-]++(?<=[lL][yY]['-]{0,4})"
CLASSIC_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
CLASSIC_PASSIVE = rf"(?i){S}{any_of('is are was were being been be')}{S}[a-z]{{2,30}}(?![\p{{L}}\p{{N}}_])(?:{S}by(?![\p{{L}}\p{{N}}_]))?"
VAGUE_LINKS = tuple(phrases("vague_link"))
