"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming (problem 9)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import exp, log
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Abbreviations after which a sentence goes on, in the languages of the texts.
NEVER = set(
    """
    mr mrs ms messrs dr prof rev gen sen gov capt lt col sgt cmdr hon pres supt st mt ft ste vs cf fig figs eq eqs vol vols pp ch sec ed eds
    i.e e.g viz approx est dept ca. art para nos op resp incl
    nr fr hr abb abt rd ca vgl bzw bspw sog mio mrd z.b d.h u.a z.t s.o s.u bd aufl tab kap ggf evtl inkl zzgl dipl ing str geb gest gem lt einschl
    mme mlle mm sté cie env av apr éd chap p.ex c.-à-d réf tél
    sra srta srtas sres dra dres dña núm núms pág págs aprox p.ej ud uds véase fig.s ee
    напр див рис бл ім вул буд кв обл проф акад доц стор зв пп канд англ нім фр лат гл таб табл тел просп пл
    डॉ श्री रु सं प्रो कि.मी
    أ د م ص
    """.split()
)
# Abbreviations that may end a sentence; what follows decides.
MAYBE = set(
    """
    inc corp ltd co llc plc jr bros etc al a.m p.m am pm u.s u.k u.n e.u u.s.a d.c ph.d m.d b.c a.d
    usw std uhr min sek jh n.chr v.chr gmbh ag
    s.a s.l uu ee.uu a.m. h hab
    р рр ст грн коп тис млн млрд год хв сек ін д т.д т.п т.ін р.р с.г н.е
    """.split()
)
# Words before whose capital letter a number with a full stop is an ordinal.
ORDINAL_NEXT = set(
    """
    januar februar märz april mai juni juli august september oktober november dezember jänner mal quartal jahrhundert platz runde etage stock
    woche sitzung ausgabe auflage kapitel jahrestag geburtstag tag halbjahr block
    """.split()
)
# Words that report a quotation.
REPORTING = re.compile(
    r"说|表示|写道|称|指出|问|道。|述べた|語った|書いた|言った|話した|尋ねた|कहा|लिखा|पूछा|बताया|(?:^|\s)و?(?:قال|قالت|سأل|سألت|كتب|كتبت|أضاف|أضافت|ذكر|صرح|أكدت?)\s"
)
REPORTING_CASED = re.compile(
    r"^[^.!?…]{0,60}?\b(?:said|says|asked|asks|added|adds|wrote|writes|noted|notes|sagte|sagt|schreibt|fragte|fragt|demande|déclare|dit|précise|dijo|añadió|preguntó|пише|каже|сказав|сказала|питає|додав|додала)\b"
)
TERMINAL = ".!?…。！？।॥؟۔｡‼⁇⁈⁉"
FULL = "。！？।॥｡"
CLUSTER = re.compile(rf"[{TERMINAL}]+(?:[\u00a0\u202f\u2009][!?…]+)*")
MARKS = re.compile(r"""[“”„«»‹›「」『』（）()\[\]【】《》"‘’]""")
PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "‹": "›"}
CLOSERS = set(PAIRS.values()) | set("”’»")
QUOTES = set("”’»«“\"」』›")
OPENERS = "“„«»‹「『（([【《\"‘'¿¡"
THAI = "ก-ฺเ-๎"
THAI_LETTER = re.compile(rf"[{THAI}]")
THAI_SPACE = re.compile(rf"(?<=[{THAI}])\s+(?=[{THAI}])")
#: What stands between words without being one: symbols, emoji, tags, entities.
NOISE = re.compile(r"(?:</?\w+>|<\|\w+\|>|&\w+;|[^\w\s\"“”„«»‘’'()\[\]{}$#@%—–,;:!?.…¿¡+-]+)\s+")
#: A capitalised word right after the mark, where a space got lost; the word before it.
GLUED, GLUED_BEFORE = re.compile(r"[^\W\d_a-zа-яіїєґ][^\W\d_A-Z]*(?=[\s,])"), re.compile(r"(?:^|\s|[(“«])[^\W\d_]{2,}$|[\d%)]$|\b[ap]\.m$")
WIDE = re.compile(r"[　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯가-힯]")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ가-힯]")
# a carriage return and the line feed after it are one break
BLANK_LINE = re.compile(r"(?:\r\n|\r(?!\n)|[\n\u2028\u2029])[^\S\n\r]*(?:\r\n|\r(?!\n)|[\n\u2028\u2029])\s*")
LINE = re.compile(r"(?:\r\n|[\n\r\u2028\u2029])")
ITEM = re.compile(r"[^\S\n\r]*(?:([•*·▪‣◦●○–-])|(\d{1,3})[.)])[^\S\n\r]+")
#: Scores of ends by their closing and the next opening word: no end; ordinary and doubtful ends.
NO, YES, LIKELY, PERHAPS = -9.0, 6.0, 4.0, 2.0
#: Cost of a span that holds only one end of a matched quotation or bracket.
BROKEN = 12.0
#: Characters of an ordinary sentence: in Chinese and Japanese, in Thai, elsewhere.
TYPICAL_WIDE, TYPICAL_THAI, TYPICAL = 30, 50, 80
#: Cost of a short span: it grows with the square of how far its logarithm lies under the ordinary one, beyond a free part.
SHORT_FREE, SHORT_COST, SHORT_MOST = 1.0, 1.6, 3.5


def blocks(text: str) -> list[tuple[int, int]]:
    """Parts of a text that sentences don't cross: paragraphs and list items, without the items' markers."""
    paragraphs, at = [], 0
    for m in BLANK_LINE.finditer(text):
        paragraphs.append((at, m.start()))
        at = m.end()
    paragraphs.append((at, len(text)))
    out = []
    for a, b in paragraphs:
        lines = [a] + [m.end() for m in LINE.finditer(text, a, b)]
        found = [ITEM.match(text, s, b) for s in lines]
        number = [int(m[2]) if m and m[2] else None for m in found]
        start, last = a, None
        for k, (s, m) in enumerate(zip(lines, found, strict=True)):
            if m is None:
                continue
            n = number[k]
            if n is not None and n != 1 and n - 1 != last and not (s == a and n + 1 in number[1:2]):
                continue  # a wrapped line that happens to start with a number
            if s > start:
                out.append((start, s))
            start, last = m.end(), n
        out.append((start, b))
    return out


def _enclosed(text: str, a: int, b: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Starts and ends of the outermost matched quotations and brackets, and the opening place of each closing one."""
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    spans, closing = [], {}

    def push(kind: str) -> None:
        stack.append((kind, at))
        held[kind] += 1

    def close(*kinds: str) -> bool:
        if not any(held[k] for k in kinds):
            return False
        while True:  # what was opened later stays unmatched
            kind, opened = stack.pop()
            held[kind] -= 1
            if kind in kinds:
                spans.append((opened, at))
                closing[at] = opened
                return True

    for m in MARKS.finditer(text, a, b):
        c, at = m.group(), m.start()
        before, after = text[at - 1] if at > a else " ", text[at + 1] if at + 1 < b else " "
        if c in PAIRS:
            push(c)
        elif c == "“":
            if not close("„"):
                push(c)
        elif c == "”":
            close("“", "„")
        elif c in "„‘":
            push(c)
        elif c == "’":
            if not after.isalnum():
                close("‘")
        elif c == "«":
            if not close("»"):
                push(c)
        elif c == "»":
            if not close("«"):
                push(c)
        elif c == '"':
            if after.isspace() or not before.isspace() or not held['"']:
                if not close('"') and not after.isspace():
                    push(c)
            else:
                push(c)
        else:
            close(*[k for k, v in PAIRS.items() if v == c])
    spans.sort()
    starts, ends = [], []
    for s, e in spans:
        if not ends or s > ends[-1]:
            starts.append(s)
            ends.append(e)
    return starts, ends, closing


def _end_score(text: str, a: int, b: int, m: re.Match, end: int, after: int, closing: dict[int, int]) -> float:
    """How well a sentence ends at ``end`` (after the marks of ``m`` and what closes with them), the next word at ``after``."""
    marks = m.group()
    c, look = text[after], after
    dash = c in "—–" or (c == "-" and after + 1 < b and text[after + 1].isspace())
    while m_noise := NOISE.match(text, look, b):
        look = m_noise.end()
    while look < b and (text[look] in OPENERS or (dash and (text[look] in "—–-" or text[look].isspace()))):
        look += 1
    first = text[look] if look < b else c
    # lower case goes on, but for names such as eXample
    if first.islower() and not (first == "e" and look + 1 < b and text[look + 1].isupper()):
        return NO
    if c in ",;:)]”’،；，、：)」』】》!?":
        return NO
    closers = text[m.end() : end].strip()
    if any(q in QUOTES for q in closers):
        opened = next((closing[p] for p in range(end - 1, m.end() - 1, -1) if p in closing), None)
        if c in "とっ" and CJK.match(c):
            return NO
        if opened is not None:
            k = opened - 1
            while k >= a and (text[k].isspace() or text[k] in OPENERS):
                k -= 1
            if k < a or text[k] in TERMINAL or text[k] in CLOSERS or text[k] in "“«":
                # the quotation began the sentence; do the words after it say whose it is?
                stop = CLUSTER.search(text, after, min(b, after + 120))
                clause = text[after : stop.end() if stop else min(b, after + 120)]
                while stop and clause[-1] == "." and len(clause.split()[-1]) <= 4 and stop.end() < b:
                    stop = CLUSTER.search(text, stop.end(), min(b, after + 160))
                    clause = text[after : stop.end() if stop else min(b, after + 120)]
                clause = normalize("NFC", clause)
                if first.isupper():
                    if len(clause) <= 80 and c not in OPENERS and REPORTING_CASED.match(clause) and not REPORTING_CASED.match(clause.split(" ", 1)[0]):
                        return NO if ":" not in clause and "“" not in clause and '"' not in clause else YES
                elif c not in OPENERS and len(clause) <= 60 and ":" not in clause and "：" not in clause and not any(q in clause for q in "“„«「\"") and REPORTING.search(clause):
                    return NO
        return YES
    if marks != ".":
        return YES if marks[0] != "…" and not marks.startswith("..") else LIKELY + 1
    k = m.start()
    while k > a and not text[k - 1].isspace() and text[k - 1] not in "(（[«“„\"‘—":
        k -= 1
    word = text[k : m.start()]
    lower = normalize("NFC", word).lower()
    if closers:
        return YES
    next_word = re.match(r"\w+", normalize("NFC", text[look : look + 24]))
    following = next_word.group().lower() if next_word else ""
    if len(word) == 1 and word.isalpha():
        prior = text[max(a, k - 4) : k].rstrip()
        if word in "hг" and prior[-1:].isdigit():
            return PERHAPS
        if word in "дп" and prior.endswith("т."):
            return PERHAPS
        if word == "р":
            return PERHAPS
        return NO
    if "ऀ" <= word[-1:] <= "ॿ":
        return NO
    if lower == "no" or lower == "nos":
        return NO if first.isdigit() else LIKELY
    if lower in ("sr", "jr"):
        prior = text[max(a, k - 30) : k].split()
        return PERHAPS if len(prior) > 1 and prior[-1][-1].isalnum() and prior[-1][0].isupper() and prior[-2][0].isupper() and prior[-2][-1].isalnum() else NO
    if lower in NEVER:
        return NO
    if lower in MAYBE or re.fullmatch(r"(?:\w\.)+\w", word):
        return PERHAPS
    if re.fullmatch(r"\d{1,2}(?:\.\d{1,2})?", word) and following in ORDINAL_NEXT:
        return NO
    return YES if first.isalpha() and not first.isdigit() else LIKELY


def _candidates(text: str, a: int, b: int) -> tuple[list[int], list[int], list[float], list[int]]:
    """Places where a sentence may end in a block, where the next word starts, the score of each end by the words around it,
    and the outermost quotation or bracket that it lies in (-1: none)."""
    starts, ends, closing = _enclosed(text, a, b)
    found: list[tuple[int, int, float, int]] = []

    def add(end: int, after: int, score: float) -> None:
        if score > NO:
            i = bisect_left(starts, end) - 1
            found.append((end, after, score, i if i >= 0 and end <= ends[i] else -1))

    for m in CLUSTER.finditer(text, a, b):
        end = m.end()
        while end < b:
            c = text[end]
            if end in closing or c in CLOSERS and c != "»":
                end += 1
            elif c in " \u00a0\u202f\u2009" and end + 1 < b and text[end + 1] == "»" and end + 1 in closing:
                end += 2
            elif c == '"' and (end + 1 == b or text[end + 1].isspace()):
                end += 1
            else:
                break
        # full marks again after what was closed, as in 」。
        more = CLUSTER.match(text, end, b)
        if end > m.end() and more:
            continue
        if end >= b:
            continue
        c = text[end]
        if not c.isspace():
            last, before = m.group()[-1], text[max(a, m.start() - 6) : m.start()]
            wide = last in FULL or (last in "!?…" and (WIDE.search(before) or WIDE.match(c)))
            if not wide:
                glued = GLUED.match(text, end, b)
                if not glued or m.group()[0] == "…" or not GLUED_BEFORE.search(text, max(a, m.start() - 30), m.start()):
                    continue
                if m.group() == "." and (text[m.start() - 1].isdigit() or not glued.group()[1:].islower()):
                    continue
        after = end
        while after < b and text[after].isspace():
            after += 1
        if after < b:
            add(end, after, _end_score(text, a, b, m, end, after, closing))
    if "฀" <= max(text[a:b], default="") and THAI_SPACE.search(text, a, b):
        for m in THAI_SPACE.finditer(text, a, b):
            add(m.start(), m.end(), YES)
        found.sort()
    return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [x[3] for x in found]


def _typical(text: str, a: int, b: int) -> int:
    if WIDE.search(text, a, b):
        wide = len(CJK.findall(text, a, b))
        return TYPICAL_WIDE if 4 * wide > b - a else TYPICAL
    return TYPICAL_THAI if THAI_LETTER.search(text, a, b) else TYPICAL


def _length_cost(n: int, typical: int) -> float:
    under = log(typical / n) - SHORT_FREE
    return min(SHORT_MOST, SHORT_COST * under * under) if under > 0 else 0.0


def block_sentences(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The best division of one block into sentences.

    A sentence is scored as a whole: by the word and marks that close it and the word that opens the next one; by its
    length, so that a doubtful end closes no span too short to be a sentence; and by its quotations and brackets, of which
    it should hold both ends or none. A pair costs the same however many ends lie in it, so one sentence or two stay
    together in a quotation, but a stray mark doesn't hold five together. best[j] is the best score of a division whose
    last sentence ends at candidate j. Only short spans need the pair of both ends; of the earlier ends, running maxima
    are kept apart by the quotation that they lie in.
    """
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a == b:
        return []
    ends, nexts, scores, held = _candidates(text, a, b)
    if not ends:
        return [(a, b)]
    begin, stop, gain = [a, *nexts], [*ends, b], [*scores, 0.0]
    within = [-1, *held, -1]  # of the place where span i begins; that of the end j is within[j + 1]
    typical = _typical(text, a, b)
    free = int(typical / exp(SHORT_FREE)) + 1
    best, back = [], []
    low = float("-inf")
    # best division up to the spans that count as short: outside quotations, and in the one that was open last
    outer, outer_at, inner, inner_at, before, before_at, pair = low, -1, low, -1, low, -1, -1
    k = 0
    for j, end in enumerate(stop):
        while k <= j and end - begin[k] >= free:
            v = best[k - 1] if k else 0.0
            p = within[k]
            if p != pair:
                if pair >= 0 and inner - BROKEN > outer:
                    outer, outer_at = inner - BROKEN, inner_at
                if p >= 0:
                    before, before_at, inner, inner_at = outer, outer_at, low, -1
                pair = p
            if p >= 0:
                if v > inner:
                    inner, inner_at = v, k
            elif v > outer:
                outer, outer_at = v, k
            k += 1
        p = within[j + 1]
        if p >= 0 and p == pair:
            top, top_at = (inner, inner_at) if inner >= before - BROKEN else (before - BROKEN, before_at)
        else:
            top, top_at = outer, outer_at
            if pair >= 0 and inner - BROKEN > top:
                top, top_at = inner - BROKEN, inner_at
            if p >= 0:
                top -= BROKEN
        for i in range(k, j + 1):
            n = end - begin[i]
            if n <= 0:
                continue
            v = best[i - 1] if i else 0.0
            if j < len(ends):  # a heading, an item or a text cut off may be as short as it likes
                v -= _length_cost(n, typical)
            q = within[i]
            if q != p:
                v -= BROKEN * ((q >= 0) + (p >= 0))
            if v > top:
                top, top_at = v, i
        best.append(top + gain[j])
        back.append(top_at)
    spans, j = [], len(stop) - 1
    while j >= 0:
        i = back[j]
        if i < 0:
            break
        spans.append((begin[i], stop[j]))
        j = i - 1
    return spans[::-1]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text by code points, without outer white space; none for null and blank texts."""
    return [s for a, b in blocks(text) for s in block_sentences(text, a, b)] if text else []


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [sentences(t) for t in batch.column(1).to_pylist()]
        owner = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
        arrays = [batch.column(0).take(pa.array(owner)), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start_char", "end_char"])


def split_documents(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of every sentence of every document; null and blank texts have none. No shuffle."""
    key = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    return documents.select("doc_id", "text").mapInArrow(_split, schema)
