"""Problem 8: sentence units of multilingual Markdown.

The standard sentence-break rules over the character properties of all scripts find the end
marks: terminators (STerm), full stops (ATerm), closing marks (Close), and continuations
(SContinue) after which nothing ends. Abbreviations of the paragraph's language, initials,
ordinals, quotations and brackets then suppress the marks that end nothing. A paragraph's
language follows from its function words, else from the record's ``lang``, else it is unknown.
Scripts without an end mark (Thai, Lao) end a unit at the space its writers set between two
letters of the script.

Null, empty and blank texts give no rows. Texts of any length are scanned whole, block
by block; extra columns of the input are ignored, a null or missing ``lang`` is unknown;
repeated ids are cut once per row and then reduced to distinct units.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread


# Every assigned character with one of the properties lies in the first two planes.
BREAKING = regex.findall(r"[\p{SB=STerm}\p{SB=ATerm}\p{SB=Close}\p{SB=SContinue}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)])))


def _having(value: str) -> str:
    """All characters with a value of the sentence-break property, as text."""
    return "".join(c for c in BREAKING if regex.match(rf"\p{{SB={value}}}", c))


# An ellipsis stands with the end marks here: whether it ends a unit depends on what follows.
TERMINATORS = _having("STerm")
STOPS = _having("ATerm")
CLOSE = _having("Close")
CONTINUE = _having("SContinue")
WIDE_ENDS = "。！？｡．"
OTHER_ENDS = "".join(c for c in TERMINATORS + STOPS if c not in ".!?‼⁇⁈⁉‽" + WIDE_ENDS)


def _ends(marks: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """One end mark, and a run of them: one before a small letter, digit or slash stands inside a name, number or address (SB6, SB7, SB8), marks in a row are one (SB8a)."""
    one = f"[{re.escape(marks)}…‥]"
    return re.compile(one), re.compile(f"(?:{one}\\s?(?=[!?！？…])|{one})+(?:(?<![.?!])|(?![a-z0-9_/=&]))")


# The marks beyond the first plane are searched for only in texts that leave it.
ENDS, ENDS_BEYOND = _ends("".join(c for c in TERMINATORS + STOPS if c <= "\uffff")), _ends(TERMINATORS + STOPS)
BEYOND = re.compile("[\U00010000-\U0010ffff]")
SPACED_SCRIPT = re.compile(r"(?<=[฀-໿])\s+(?=[฀-໿])")
PAIR_MARK = re.compile(r"[\"“”„«»「」『』《》〈〉()（）\[\]［］{}【】]")
# Opening marks with their closing marks.
PAIRS = {
    "(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】",
    "«": "»", "»": "«", "“": "”", "„": "“”", "「": "」", "『": "』", "《": "》", "〈": "〉", '"': '"',
}
BRACKETS = set("(（[［{【")

# Abbreviations, by language, that never end a sentence, whatever follows.
SUPPRESSED = {
    "en": "mr mrs ms messrs dr prof eng st rev gen col capt lt sgt hon gov sen rep vs e.g i.e viz approx esp resp incl dept est a.k.a cf",
    "it": "sig sigg sig.ra dott dott.ssa avv ing geom rag arch on prof cfr ca es p.es ad.es soc v dr",
    "de": "z.b d.h u.a bzw vgl hr hrn fr frl dipl dipl.-ing ggf evtl sog inkl zzgl geb ca dr prof resp approx v",
    "fr": "m mm mme mlle me dr pr prof ex env cf resp approx",
    "es": "sra srta dr dra prof lic ing ud uds ej aprox ee véase cf av gral",
    "hi": "डॉ श्री प्रो पं",
    "ar": "د أ م",
}
SUPPRESSED = {lang: frozenset(words.split()) for lang, words in SUPPRESSED.items()}
# Those that are words, or mark nothing, in another language, and are suppressed in their own only.
OWN_ONLY = frozenset("on est env es v rep sen gen col me ex pr arch eng rev hon fr st m ing av lic gov incl dept esp capt hr geb rag ud".split())
# Titles that stand before a name, so with a capital; in small letters they are words.
TITLES = frozenset("gen col capt lt sgt hon gov sen rep rev eng st prof on arch".split())
ANYWHERE = frozenset().union(*SUPPRESSED.values()) - OWN_ONLY
# Words by which a paragraph shows its language.
FUNCTION_WORDS = {
    "en": "the is are was were and of to in it that this with for from not they he she we you be has have had then after before when which who at by an as but or if its run set",
    "it": "il lo la gli le un una di del della dei delle che non è sono per con da dal dalla nel nella si ha hanno al alla ai come anche più questo questa ma se poi e i o in ogni viene",
    "de": "der die das und nicht wird ist sind ein eine einer im in den dem des mit von zu auf für hat noch seit auch es er sie nach bei aus wie oder wenn wurde werden schreibt endet fehlen als am",
    "fr": "le la les un une des du de et est sont dans que qui ne pas pour par avec sur il elle au aux ce cette a ont plus comme ou mais si puis son sa ensuite en se",
    "es": "el la los las un una de del y es son que no en por para con se al lo su sus como más pero si ya este esta ha han muy cuando o a fue sin",
}
FUNCTION_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
LANGS_OF = {w: [lang for lang, words in FUNCTION_WORDS.items() if w in words] for w in frozenset().union(*FUNCTION_WORDS.values())}
LATIN_WORD = re.compile(r"[^\W\d_]+")
# Spellings of the languages that the marks depend on.
LANGS = {
    "en": "en eng english", "it": "it ita italian italiano", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "hi": "hi hin hindi", "ar": "ar ara arabic",
}
LANGS = {name: lang for lang, names in LANGS.items() for name in names.split()}
# Abbreviations that stand before a number; before anything else they may end a sentence.
BEFORE_NUMBER = frozenset(
    "no nos nr n num núm p pp pag pagg pág págs art artt fig figs sec sect cap capp chap ch vol abs kap s max min avg ver eq tab abb bd ref par".split()
)
# Abbreviations that end a sentence when a new one follows.
MAY_END = frozenset("etc ecc usw inc ltd co corp jr sr a.m p.m u.s u.k u.s.a s.p.a s.r.l s.a al uu bros gmbh".split())
# Longer runs are neither abbreviation nor word nor file name (no file system has longer names).
LONGEST = 255

FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
BULLET = re.compile(r"[ \t]*(?:[-*+•‣◦][ \t]+|(\d{1,9})[.)][ \t]+)")
RULE = re.compile(r"[ \t]*(?:-[ \t]*){3,}$|[ \t]*(?:\*[ \t]*){3,}$|[ \t]*(?:_[ \t]*){3,}$|[ \t]*=+[ \t]*$")
QUOTE_PREFIX = re.compile(r"[ \t]{0,3}>[ \t]?")
FILE_NAME = re.compile(r"[\w-]+(?:[./\\][\w-]+)+|\w+_\w+")
WORD_BEFORE = re.compile(r"[^\s(（\[«„“\"'’]*$")
INITIAL = re.compile(r"[^\W\d_]$")


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text that hold sentences: headings, list items and paragraphs; code fences and rules are left out."""
    start = end = -1
    fence, number, in_list = "", -1, False
    pos = 0
    for line in text.split("\n"):
        here, pos = pos, pos + len(line) + 1
        body = line.rstrip()
        if fence:
            if body.lstrip().startswith(fence) and not body.strip().strip(fence[0]):
                fence = ""
            continue
        opened = FENCE.match(body)
        if opened:
            if start >= 0:
                yield start, end
            start, fence, in_list = -1, opened.group(1), False
            continue
        if not body.strip():
            if start >= 0:
                yield start, end
            start = -1
            continue
        head = HEADING.match(body)
        if head or RULE.match(body):
            if start >= 0:
                yield start, end
            start, in_list = -1, False
            if head:
                title = re.sub(r"(?:^|[ \t])#+$", "", body[head.end() :]).rstrip()
                if title:
                    yield -(here + head.end()) - 1, here + head.end() + len(title)
            continue
        quoted = QUOTE_PREFIX.match(body)
        offset = quoted.end() if quoted else 0
        item = BULLET.match(body, offset)
        if item:
            n = int(item.group(1)) if item.group(1) else None
            # In a running paragraph a number opens an item only as 1; in a list only as the next number.
            if n is not None and start >= 0 and not (n == 1 or in_list and n == number + 1):
                item = None
            else:
                number, in_list = (n if n is not None else -1), True
        if item:
            if start >= 0:
                yield start, end
            start = here + item.end()
        elif start < 0:
            start, in_list = here + offset, in_list and line[:1] in " \t"
        end = here + len(body)
    if start >= 0:
        yield start, end


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotation marks and brackets of a block."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    awaited: dict[str, int] = {}  # closing marks that would match something on the stack
    for m in PAIR_MARK.finditer(text, start, end):
        mark, at = m.group(), m.start()
        if awaited.get(mark):
            while True:
                top, opener = stack.pop()
                for c in PAIRS[top]:
                    awaited[c] -= 1
                if mark in PAIRS[top]:
                    break
            while found and found[-1][0] > opener:
                found.pop()
            found.append((opener, at))
        elif mark in PAIRS and mark != "»":
            stack.append((mark, at))
            for c in PAIRS[mark]:
                awaited[c] = awaited.get(c, 0) + 1
    return found


def _marks(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of end marks that may end a sentence."""
    one, run = ENDS_BEYOND if BEYOND.search(text, start, end) else ENDS
    at = start
    while m := one.search(text, at, end):
        found = run.match(text, m.start(), end)
        if found:
            yield found.span()
        at = found.end() if found else m.end()


def _wide(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "가" <= ch <= "힯" or "豈" <= ch <= "﫿"


def _starts_sentence(text: str, at: int) -> bool | None:
    """Whether what stands at ``at`` can open a sentence; None where the script has no case."""
    ch = text[at]
    if ch.islower():
        m = FILE_NAME.match(text, at)
        return bool(m)
    if ch.isupper() or ch.isdigit() or ch in "¿¡":
        return True
    if ch in PAIRS and ch not in "»":
        return True
    return None if ch.isalpha() else ch in "-–—.`*_#@$'‘"


def language_of(text: str, start: int, end: int, said: str | None) -> str | None:
    """The language of a paragraph: by its function words, ties and none by what the record says (null where that tells nothing)."""
    counts = Counter(lang for word in LATIN_WORD.findall(text[start:end].lower()) for lang in LANGS_OF.get(word, ()))
    if not counts:
        return said
    most = max(counts.values())
    best = [lang for lang in FUNCTION_WORDS if counts[lang] == most]
    return best[0] if len(best) == 1 or said not in best else said


def _word_before(text: str, unit: int, at: int) -> str:
    """What stands before ``at`` without white space; nothing where it is longer than a name can be."""
    word = WORD_BEFORE.search(text, max(unit, at - LONGEST - 1), at).group()
    return word if len(word) <= LONGEST else ""


class _Language:
    """The language of a block, found out only if a mark depends on it."""

    def __init__(self, text: str, start: int, end: int, said: str | None) -> None:
        self.block, self.found, self.lang = (text, start, end, said), False, None

    def __call__(self) -> str | None:
        if not self.found:
            self.found, self.lang = True, language_of(*self.block)
        return self.lang


def _abbreviated(word: str, raw: str, lang: _Language) -> bool:
    if word not in ANYWHERE and not (word in OWN_ONLY and word in SUPPRESSED.get(lang(), ())):
        return False
    return word not in TITLES or raw[:1].isupper()


def _full_stop_ends(text: str, unit: int, at: int, nxt: int, lang: _Language) -> bool:
    raw = _word_before(text, unit, at).strip(".")
    word = raw.lower()
    follows = text[nxt]
    if _abbreviated(word, raw, lang):
        return False
    if word in BEFORE_NUMBER and (follows.isdigit() or follows == "."):
        return False
    if word == "sr" and not re.search(r"(?:^|\s)(?!(?:El|La|Los|Las|Il|Lo|The|Der|Le)\s)[A-ZÀ-Þ][\w'-]+\s+$", text[max(unit, at - 32) : at - 2]):
        return False  # a title before a name, not the elder of two after one
    if word in MAY_END:
        return follows.isupper() or follows in "¿¡«„“\"(" or FILE_NAME.match(text, nxt) is not None
    if len(word) == 1 and INITIAL.match(word):
        return not (raw.isupper() or raw.islower() or not raw.isascii())
    if re.fullmatch(r"(?:[a-z]\.)+[a-z]", word):
        return False
    return not (word.isdigit() and len(word) <= 2 and follows.isalpha() and lang() == "de")


def _glued(text: str, unit: int, at: int, nxt: int) -> bool:
    """Whether a new sentence follows an end mark without the space between: a word or a file name before, a capitalized word after."""
    word = _word_before(text, unit, at)
    plain = LETTERS.match(word) is not None or re.fullmatch(r"[\w/-]+(?:\.[\w-]+)*\.[a-z]{1,4}", word) is not None
    return len(word) > 1 and plain and GLUED.match(text, nxt) is not None


def _cut(text: str, start: int, end: int, said: str | None) -> Iterator[tuple[int, int]]:
    unit, lang = start, _Language(text, start, end, said)
    pairs = _pairs(text, start, end)
    events = [(a, b, None) for a, b in _marks(text, start, end)]
    if pairs:
        kept, k = [], 0
        for a, b, _ in events:
            while k < len(pairs) and pairs[k][1] < a:
                k += 1
            if not (k < len(pairs) and pairs[k][0] < a < pairs[k][1]):
                kept.append((a, b, None))
        for o, c in pairs:
            tail = c
            while tail > o + 1 and (text[tail - 1].isspace() or text[tail - 1] in PAIR_CLOSERS):
                tail -= 1
            if tail - 1 > o and text[tail - 1] in ALL_ENDS:
                kept.append((tail - 1, c + 1, (o, c)))
        events = sorted(kept, key=lambda e: e[:2])
    opens_at = {o for o, _ in pairs}
    if SPACED_SCRIPT.search(text, start, end):
        k = 0
        for m in SPACED_SCRIPT.finditer(text, start, end):
            while k < len(pairs) and pairs[k][1] < m.start():
                k += 1
            if not (k < len(pairs) and pairs[k][0] < m.start()):
                events.append((m.start(), m.start(), "space"))
        events.sort(key=lambda e: e[:2])
    for a, b, pair in events:
        if a < unit:
            continue
        nxt = b
        while nxt < end and text[nxt] in PAIR_CLOSERS and pair is None and nxt not in opens_at:
            nxt += 1
        b = nxt
        while nxt < end and text[nxt].isspace():
            nxt += 1
        if nxt >= end:
            break
        if pair == "space":
            yield unit, a
            unit = nxt
            continue
        gap, follows = nxt > b, text[nxt]
        if follows in NEVER_AFTER:
            continue
        mark = text[a:b].rstrip(AFTER_MARK)
        if pair:
            run = a
            while run > pair[0] and text[run - 1] in ".…":
                run -= 1
            mark = text[run : a + 1]
        ellipsis = mark.endswith(("…", "..")) or mark in ("...",)
        opens = _starts_sentence(text, nxt)
        if pair:
            o = pair[0]
            if text[o] in BRACKETS:
                ok = o == unit and opens is not False
            elif opens is None or _wide(follows):
                before = text[unit:o].rstrip()
                ok = not ellipsis and before.endswith((":", "："))
            else:
                ok = bool(opens) and (gap or GLUED.match(text, nxt) is not None)
        elif _wide(follows) or opens is None:
            if ellipsis:
                ok = gap and not _wide(follows)
            elif mark[-1] in WIDE_ENDS or mark[-1] in OTHER_ENDS:
                ok = True
            elif mark == ".":
                ok = (gap or text[a - 1].isalpha() and not text[a - 1].isascii() and not _wide(follows)) and _full_stop_ends(text, unit, a, nxt, lang)
            else:
                ok = gap or _wide(follows)
        elif mark[-1] in WIDE_ENDS or mark[-1] in OTHER_ENDS:
            ok = not (ellipsis and not gap)
        elif not gap and not _glued(text, unit, a, nxt):
            ok = False
        elif not opens:
            ok = False
        elif mark == ".":
            ok = _full_stop_ends(text, unit, a, nxt, lang)
        else:
            ok = True
        if ok:
            yield unit, b
            unit = nxt
    if unit < end:
        yield unit, end


GLUED = re.compile(r"[\"«„“¿¡(]?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]*[ ,\n]|[\"«„“¿¡]\w")
LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$")
# Closing marks and quotes; » is one only by its place, as are dashes no continuation: both may open what follows.
PAIR_CLOSERS = frozenset(c for c in CLOSE if regex.match(r"[\p{Pe}\p{Pf}]", c)) | frozenset("\"'")
AFTER_MARK = "".join(PAIR_CLOSERS) + "   "
ALL_ENDS = frozenset(TERMINATORS + STOPS + "…‥")
NEVER_AFTER = frozenset(c for c in CONTINUE if not regex.match(r"\p{Pd}", c)) | (PAIR_CLOSERS - frozenset("\"'’"))


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """Offsets of the sentence units of one text, end exclusive; ``lang`` as the record spells it."""
    said = LANGS.get(re.split(r"[-_.@ ]", lang.strip().lower())[0]) if lang else None
    out = []
    for start, end in _blocks(text):
        heading = start < 0
        if heading:
            start = -start - 1
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start >= end:
            continue
        if heading:
            out.append((start, end))
        else:
            for s, e in _cut(text, start, end, said):
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
    return out


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = True) -> DataFrame:
    """One row per sentence unit: id, ``sentence_no`` from 1, ``start_pos``, ``end_pos`` and, if asked, the sentence."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, sentence_no int, start_pos int, end_pos int" + ", sentence string" * with_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nos, starts, ends, said = [], [], [], [], []
            for key, text, lang in zip(pdf[id_col], pdf[text_col], pdf["_lang"]):
                if not text:
                    continue
                for no, (s, e) in enumerate(sentence_spans(text, lang), 1):
                    ids.append(key)
                    nos.append(no)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        said.append(text[s:e])
            cols = {id_col: ids, "sentence_no": nos, "start_pos": starts, "end_pos": ends}
            if ids:
                yield pd.DataFrame(cols | ({"sentence": said} if with_text else {}))

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    slim = docs.select(id_col, text_col, lang.cast("string").alias("_lang")).where(f"{text_col} is not null and {id_col} is not null")
    return spread(slim, id_col).mapInPandas(cut, schema)
