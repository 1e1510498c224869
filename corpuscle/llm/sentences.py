"""Sentence boundaries across languages and scripts.

A text falls into lines; a line break always ends a unit (headings, list items and
fragments are units). A line is read from left to right once, its time in proportion
to its length. The scan meets every terminator, quote and bracket, the lattice of
possible ends:

* spaced scripts: an end is taken by the word before the terminator (abbreviation,
  initial, ordinal, list mark, number), by what follows (capital, caseless letter,
  opening mark, ``eName`` words) and by the quotes and brackets around it;
* spaceless scripts (Chinese, Japanese, Thai): the text beside a gap (a terminator, a
  closing mark, an ellipsis, a blank) is segmented by a dictionary word lattice
  (cheapest path), and the gap is classified by a sum: what the gap is by itself, the
  final particle or joining word that ends the left side, and the opening, joining or
  quoting word that begins the right side.

The dictionary has the closed-class words as fixed values; the open-class words come
from the collection (``dictionary``): all texts are parted at the closed-class words,
and what lies between them often enough is a word, as is a closed-class word grown
together with its neighbour ("ที่" in "พื้นที่"), so that it isn't taken for a particle.

Ends inside quotes or brackets don't count; an end right before the closing mark
counts after it, if what follows opens a sentence. A mark that is never closed in
its line has no effect.

Defined cases: null, empty and blank texts have no sentences; spans are half-open
code points of the stored text without outer white space; every other code point
belongs to exactly one span; repeated deliveries of an item count once; rows with a
null id are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, those that may, before a capital, and those that bind a number.
NEVER = frozenset(
    "vs e.g i.e cf ca z.b d.h u.a o.ä s.o bzw vgl evtl ggf usw p.ej ej p.ex c.-à-d c.à.d fig figs sec secs sect eq eqs tab app ch chap pp par "
    "dr prof dra dres mr mrs ms mme mlle st sr sra mag dipl ing hrsg nr abb kap bd gen col lt capt rev hon डॉ प्रो श्री د أ viz resp incl ดร ผศ รศ".split()
)
MAY = frozenset("al approx etc jr sr. inc ltd co corp et.al ff ss ibid op".split())
NUMBERED = frozenset("no nos nr núm num art vol vols bd p pp s para §".split())
#: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am im der dem den des die das vom zum zur bis ab seit jeden jedem jeder und".split())
LONGEST_WORD, LONGEST_ARTICLE = (max(map(len, words)) for words in (NEVER | MAY | NUMBERED, BEFORE_ORDINAL))

# Closed-class words of spaceless scripts. Words that open a sentence, words that join what lies left of them,
# words that join what lies right of them, words that follow a quotation, verbs of speech behind the speaker, particles that go on after a closing mark, words that end a sentence.
OPENING = {
    "th": "เรา นอกจากนี้ อย่างไรก็ตาม เหตุใด ดังนั้น แต่ทว่า ในทางปฏิบัติ จากการทดลอง ทำไม สรุปแล้ว ตัวอย่างเช่น โดยทั่วไป เพราะฉะนั้น ในที่สุด ต่อมา อนึ่ง ทั้งนี้".split(),
    "ja": "しかし さらに また したがって そのため なぜ そう 一方 そして ただし つまり なお まず 次に とても ところで ところが とはいえ とりわけ とある でも では だが だから もし もちろん".split(),
    "zh": "此外 然而 因此 但是 首先 其次 最后 为什么 于是 不过 总之 例如 另外 同时 所以 虽然 如果 我们 本文".split(),
}
JOINING = {"th": "และ หรือ ของ ที่ ใน กับ ว่า เพื่อ โดย ซึ่ง จาก เพราะ แต่ เมื่อ ถ้า".split(), "ja": "の を と や".split(), "zh": "和 与 的 及 或".split()}
JOINED = {"th": "และ หรือ กับ ว่า ซึ่ง ของ ๆ".split(), "ja": [], "zh": []}
QUOTING = {"th": [], "ja": "と って という といった など などと".split(), "zh": "写道 说 问 道 表示 指出 的 地 一词 一句 等 ， 、 。".split()}
REPORTING = {"th": [], "ja": [], "zh": "说 道 问 写道 喊道 答道 说道 问道 回答 表示 指出".split()}
GOING_ON = {"th": [], "ja": "の は が を に も で へ や".split(), "zh": "和 与 是 为".split()}
FINAL = {"th": "ครับ ค่ะ คะ นะ ไหม หรือไม่ แล้ว".split(), "ja": "です ます でした ました した する いる ある ない だ か ね よ".split(), "zh": "了 吗 呢 吧 啊".split()}
#: What a gap counts by itself; above 0 it parts sentences.
GAPS = {
    "th": {"stop": 2, "mark": 2, "closed": 1, "trail": 0, "blank": 1, "mixed": 0},
    "ja": {"stop": 2, "mark": 2, "closed": 1, "trail": 0, "blank": -1, "mixed": -1},
    "zh": {"stop": 3, "mark": 3, "closed": 1, "trail": 0, "blank": -1, "mixed": -1},
}

_OPEN, _CLOSE = "“„«「『([（【‘‹", "”»」』)]）】›"
_PAIR = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "‹": "›"}
_OPENERS = {"”": "“„", "“": "„", '"': '"', **{close: open for open, close in _PAIR.items() if close not in "”“"}}
_STRONG = "。！？｡।॥۔"
_MARKS = re.compile(r"[.!?…؟。！？｡।॥۔．]+|[“”„«»「」『』()\[\]（）【】‹›\"]")
_CLOSERS = re.compile(r"[”»」』)\]）】\"'’“]+")
_NUMBERING = re.compile(r"[A-Z]?\d+(?:\.\d+)*")
_SHORT_MARK = re.compile(r"\(?(?:\d{1,3}|[^\W\d_]|[ivxIVX]{1,5})")
_ADDRESS = re.compile(r"[/@:\\]|\.[^\W\d]")
_BEFORE = "([“„«\"「（"
_THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f])[ \t\xa0\u3000]+(?=[\u0e00-\u0e7f])|(?<=[A-Za-z0-9])[ \t\xa0]+(?=[\u0e00-\u0e7f])|(?<=[\u0e00-\u0e7f])[ \t\xa0]+(?=[A-Za-z0-9])")
_HAN_GAP = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u9fff])[ \t\xa0\u3000]+(?=[\u3040-\u30ff\u3400-\u9fff])")
_THAI, _KANA, _HAN = "\u0e00-\u0e7f", "\u3040-\u30ff", "\u3400-\u9fff"
_IS_THAI, _IS_KANA, _IS_HAN = (re.compile(f"[{c}]") for c in (_THAI, _KANA, _KANA + _HAN))
_CANDIDATE = re.compile(r"[.!?…؟。！？｡।॥۔．\n\r\x0b\x0c\x85\u2028\u2029\u0e00-\u0e7f\u3000]|[\u3040-\u30ff\u3400-\u9fff][ \t\xa0]")

#: Words of the collection in a dictionary per language, least occurrences of one, its longest length, characters beside a gap that the lattice reads.
MOST_WORDS, LEAST_OCCURRENCES, LONGEST, REACH = 20_000, 5, 16, 24
#: The share of a run's occurrences beside a closed-class word from which the two are one word.
GROWN = 0.5


class Lattice:
    """Cheapest segmentation over a dictionary; text it doesn't know costs more by character.

    ``words`` have a cost of 1; those of ``learned`` (word to occurrences) a little more, the more the rarer they are.
    """

    def __init__(self, words: list[str], learned: dict[str, int] | None = None):
        self.costs = {w: 1.0 + 0.5 / (1.0 + math.log2(n)) for w, n in (learned or {}).items()}
        self.costs.update((w, 1.0) for w in words)
        # Lengths of words by their first character, and what was segmented lately.
        self.lengths: dict[str, list[int]] = {}
        for c, size in sorted({(w[0], len(w)) for w in self.costs}):
            self.lengths.setdefault(c, []).append(size)
        self.lately: dict[str, list[str]] = {}

    def segment(self, text: str) -> list[str]:
        if text not in self.lately:
            if len(self.lately) >= 20_000:
                self.lately.clear()
            self.lately[text] = self._cheapest(text)
        return self.lately[text]

    def _cheapest(self, text: str) -> list[str]:
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
        for i in range(n):
            cost = best[i][0]
            # An unknown run may take one character at a time; runs are joined below.
            if cost + 2.0 < best[i + 1][0]:
                best[i + 1] = (cost + 2.0, i)
            for size in self.lengths.get(text[i], ()):
                own = self.costs.get(text[i : i + size]) if i + size <= n else None
                if own is not None and cost + own < best[i + size][0]:
                    best[i + size] = (cost + own, i)
        cuts, at = [n], n
        while at:
            at = best[at][1]
            cuts.append(at)
        out: list[str] = []
        unknown = False
        for a, b in zip(cuts[::-1], cuts[-2::-1]):
            piece = text[a:b]
            known = piece in self.costs
            if unknown and not known:
                out[-1] += piece
            else:
                out.append(piece)
            unknown = not known
        return out

    def first(self, text: str, at: int) -> list[str]:
        """The two words from ``at`` on."""
        return [*self.segment(text[at : at + REACH]), "", ""][:2]

    def last(self, text: str, at: int) -> str:
        """The word that ends at ``at``."""
        found = self.segment(text[max(0, at - REACH) : at])
        return found[-1] if found else ""


def closed_class(language: str) -> list[str]:
    return [w for kind in (OPENING, JOINING, JOINED, QUOTING, REPORTING, GOING_ON, FINAL) for w in kind[language]]


class Gaps:
    """Classifies gaps of spaceless scripts by the words beside them."""

    def __init__(self, learned: dict[str, dict[str, int]] | None = None):
        self.lattices = {k: Lattice(closed_class(k), (learned or {}).get(k)) for k in GAPS}
        self.sets = {k: tuple(frozenset(kind[k]) for kind in (OPENING, JOINING, JOINED, QUOTING, REPORTING, GOING_ON, FINAL)) for k in GAPS}
        # What the right side must begin with and the left side end with, so that the words beside a gap may count against or for it.
        self.against = {k: (tuple(JOINED[k] + QUOTING[k] + GOING_ON[k]), tuple(JOINING[k])) for k in GAPS}
        self.for_it = {k: (tuple(OPENING[k]), tuple(FINAL[k])) for k in GAPS}

    def parts(self, text: str, left: int, right: int, kind: str, language: str) -> bool:
        """The gap between ``left`` and ``right`` parts sentences."""
        opening, joining, joined, quoting, reporting, going_on, final = self.sets[language]
        total = GAPS[language][kind]
        begins, ends = self.against[language] if total > 0 else self.for_it[language]
        spoken = bool(reporting) and kind in ("closed", "trail")
        if not (text.startswith(begins, right) or text.endswith(ends, 0, left) or (spoken and total > 0)):
            return total > 0
        after, then = self.lattices[language].first(text, right)
        before = self.lattices[language].last(text, left)
        if after in opening:
            total += 1
        elif after in quoting and (kind != "stop" or language == "ja") or after in joined or (kind in ("closed", "trail") and (after in going_on or then in reporting)):
            total -= 2
        if before in final:
            total += 1
        elif before in joining and kind in ("blank", "mixed", "trail"):
            total -= 2
        return total > 0


PLAIN = Gaps()


def _opens(text: str, at: int) -> bool:
    """A sentence may begin here: a capital, a caseless letter, a digit, an opening mark or a name like eName."""
    c = text[at]
    if c.isalpha():
        return not c.islower() or (at + 1 < len(text) and text[at + 1].isupper())
    return c.isdigit() or c in _OPEN or c in "\"'¿¡‘’#*`$@<—–-•§" or ord(c) > 0x2190


class Words:
    """The word before each full stop of a line, met from left to right; what was read once isn't read again."""

    def __init__(self, text: str, start: int, stop: int):
        self.text, self.start = text, start
        numbering = _NUMBERING.match(text, start, stop)
        self.numbered = numbering.end() if numbering else start
        self.left, self.seen = start, start
        self.chain, self.chain_left, self.dotted = -1, -1, False
        self.address, self.address_to = False, start

    def meet(self, dot: int) -> None:
        text, at = self.text, dot
        while at > self.seen and not text[at - 1].isspace() and text[at - 1] not in _BEFORE:
            at -= 1
        if at > self.seen:
            self.left = at
        elif self.seen > self.start and (text[self.seen - 1].isspace() or text[self.seen - 1] in _BEFORE):
            self.left = self.seen
        self.seen = dot
        # Letters each followed by a full stop: the chain goes on, begins with this letter, or ends.
        alone = dot - 1 == self.left
        goes_on = self.chain_left == self.left and (self.chain == dot - 2 or (self.chain == dot - 3 and text[dot - 2] == "-"))
        letter = dot > self.left and text[dot - 1].isalpha()
        self.dotted = letter and goes_on and not alone
        if letter and (alone or goes_on):
            self.chain, self.chain_left = dot, self.left

    def lower(self, dot: int) -> str:
        """The word in small letters, empty where it is longer than any listed word."""
        return self.text[self.left : dot].lower() if dot - self.left <= LONGEST_WORD else ""

    def is_address(self, dot: int) -> bool:
        if self.address_to < self.left:
            self.address, self.address_to = False, self.left
        if not self.address:
            self.address = bool(_ADDRESS.search(self.text, self.address_to, dot))
            self.address_to = max(self.address_to, dot - 1)
        return self.address

    def bound(self, dot: int) -> bool:
        """The full stop belongs to the word before it: an initial or an abbreviation."""
        low = self.lower(dot)
        return (dot - self.left == 1 and self.text[self.left].isalpha()) or low in NEVER or low in MAY or self.dotted

    def list_mark(self, dot: int) -> bool:
        """Nothing but a list mark lies before the full stop in its line."""
        return self.start < dot <= self.numbered or (dot - self.start <= 6 and bool(_SHORT_MARK.fullmatch(self.text, self.start, dot)))

    def before(self) -> str:
        """The word before the word in small letters, if it isn't longer than the listed ones."""
        end = self.left
        while end > self.start and self.text[end - 1].isspace():
            end -= 1
        found = self.text[max(self.start, end - LONGEST_ARTICLE - 1) : end].split()
        return found[-1].lower() if found else ""


def _full_stop_ends(text: str, words: Words, dot: int, after: int, spaced: bool) -> bool:
    """The full stop at ``dot`` ends a sentence, ``after`` being what follows."""
    c = text[after]
    size = dot - words.left
    if not size or not _opens(text, after):
        return False
    last = text[dot - 1]
    if last in _CLOSE or last in "\"'’“":
        return spaced or c.isupper()
    low = words.lower(dot)
    if size == 1 and last.isalpha() or low in NEVER or words.dotted:
        return False
    if low in NUMBERED and c.isdigit():
        return False
    if low in MAY:
        return spaced and c.isalpha() or c in "“«„\"¿¡"
    if words.list_mark(dot):
        return False
    if not spaced:
        # A missing blank: a capital word after a word or number; not inside names and addresses.
        follows = after + 1 < len(text) and (text[after + 1].islower() or text[after + 1].isspace())
        named = c.isupper() and follows or c in "“«¿¡" or c.islower() or (c.isalpha() and not c.isupper())
        return named and size > 1 and (last.isalnum() or last == "%") and not words.is_address(dot)
    if size <= 2 and c.isupper() and text[words.left : dot].isdigit() and words.before() in BEFORE_ORDINAL:
        return False
    return not (c in "([" and low in NUMBERED)


def _paired(marks: list[tuple[int, int, str]]) -> list[int]:
    """Per mark 1 if it opens a pair that is closed in its line, -1 if it closes one, else 0."""
    role = [0] * len(marks)
    stack: list[int] = []
    waiting: dict[str, int] = {}
    for i, (_, _, mark) in enumerate(marks):
        closes = _OPENERS.get(mark)
        if mark == "“" and (not stack or marks[stack[-1]][2] != "„"):
            closes = None
        if closes and any(waiting.get(o) for o in closes):
            # Marks opened since then stay open: they have no effect.
            while True:
                top = stack.pop()
                waiting[marks[top][2]] -= 1
                if marks[top][2] in closes:
                    role[top], role[i] = 1, -1
                    break
        elif mark == '"' or mark in _PAIR:
            stack.append(i)
            waiting[mark] = waiting.get(mark, 0) + 1
    return role


def _line_cuts(text: str, start: int, stop: int, gaps: Gaps, han: str) -> list[int]:
    """Places in (start, stop) where a unit ends and another begins; ``han``: the language of its Chinese characters."""
    cuts: list[int] = []
    marks = [(m.start(), m.end(), m.group()) for m in _MARKS.finditer(text, start, stop)]
    if not marks:
        return cuts
    role = _paired(marks)
    words = Words(text, start, stop)
    depth = 0
    pending = -1  # the end of a sentence that ended inside, right before a closing mark
    for (at, end, mark), part in zip(marks, role):
        if part > 0:
            depth += 1
            continue
        if part < 0:
            depth -= 1
            if pending == at and not depth:
                _after_closing(text, end, stop, cuts, gaps, han)
            pending = end if pending == at else -1
            continue
        if mark in _OPENERS or mark in _PAIR:
            # Without a partner.
            if mark in _CLOSE:
                pending = end if pending == at else -1
            continue
        if mark == ".":
            words.meet(at)
        if depth:
            # Inside: it counts after the closing mark, unless it belongs to an abbreviation.
            inner = mark != "." or not words.bound(at)
            while inner and end < stop and text[end] in " \xa0\u202f":
                end += 1
            pending = end if inner else -1
            continue
        # White space before a closing mark belongs to it.
        end = _closers(text, end, stop)
        after = end
        while after < stop and text[after].isspace():
            after += 1
        if after >= stop:
            continue
        spaced = after > end
        if mark[-1] in "。！？｡":
            ends = text[after] not in "，、,；;：:）)」』”»" and gaps.parts(text, at, after, "mark" if mark[-1] in "！？" else "stop", han)
        elif mark[-1] in _STRONG:
            ends = text[after] not in "，、,；;：:）)」』”»"
        elif mark[-1] == "؟":
            ends = text[after] not in "،,؛»)"
        elif mark[0] in ".…" and (len(mark) > 1 or mark == "…"):
            if _IS_HAN.match(text, after):
                ends = gaps.parts(text, at, after, "trail", han)
            else:
                ends = spaced and _opens(text, after) and not text[after].isdigit()
        elif mark == ".":
            ends = _full_stop_ends(text, words, at, after, spaced)
        elif mark == "．":
            ends = spaced
        else:
            ends = _opens(text, after) and (spaced or text[after].isupper() or text[after] in "“«„¿¡\"" or ord(text[after]) > 0x2E80)
        if ends:
            cuts.append(after)
    return cuts


def _closers(text: str, end: int, stop: int) -> int:
    """Behind the closing marks at ``end`` that nothing opened here."""
    m = _CLOSERS.match(text, end, stop)
    if not m:
        return end
    # A quote mark that stands before a letter opens, it doesn't close.
    last = m.end()
    while last > end and text[last - 1] in "\"'“’" and last < stop and not text[last].isspace():
        last -= 1
    return last


def _after_closing(text: str, end: int, stop: int, cuts: list[int], gaps: Gaps, han: str) -> None:
    """A sentence ended inside the mark that closes before ``end``."""
    end = _closers(text, end, stop)
    after = end
    while after < stop and text[after].isspace():
        after += 1
    if after >= stop or text[after] in ".,;:!?，。、；：！？）)」』”»؟،":
        return
    c = text[after]
    if ord(c) > 0x2E80 or ord(text[end - 1]) > 0x2E80:
        if not gaps.parts(text, end - 1, after, "closed", han):
            return
        if c.isascii() and not (after > end or _opens(text, after)):
            return
        cuts.append(after)
    elif _opens(text, after) and (after > end or c.isupper()) and c not in "—–-":
        cuts.append(after)


def _blank_cuts(text: str, start: int, stop: int, gaps: Gaps, language: str) -> list[int]:
    """Blanks that part sentences of spaceless scripts."""
    cuts = []
    for m in (_THAI_GAP if language == "th" else _HAN_GAP).finditer(text, start, stop):
        kind = "blank"
        if language == "th":
            before, after = bool(_IS_THAI.match(text[m.start() - 1])), bool(_IS_THAI.match(text[m.end()]))
            if not before or (not after and not text[m.end()].isupper()):
                kind = "mixed"
                if not after:
                    continue
        if gaps.parts(text, m.start(), m.end(), kind, language):
            cuts.append(m.end())
    return cuts


_BREAK = re.compile(r"[\n\r\x0b\x0c\x85  ]+")


def spans(text: str, gaps: Gaps = PLAIN) -> list[tuple[int, int]]:
    """The sentences of ``text``."""
    n = len(text)
    if not _CANDIDATE.search(text):
        left = n - len(text.lstrip())
        right = len(text.rstrip())
        return [(left, right)] if left < right else []
    han = "ja" if _IS_KANA.search(text) else "zh"
    spaceless = [language for language, sign in (("th", _IS_THAI), (han, _IS_HAN)) if sign.search(text)]
    out = []
    at = 0
    lines = []
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, n))
    for start, stop in lines:
        while start < stop and text[start].isspace():
            start += 1
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if start == stop:
            continue
        cuts = _line_cuts(text, start, stop, gaps, han)
        if spaceless:
            cuts = sorted({*cuts, *(cut for language in spaceless for cut in _blank_cuts(text, start, stop, gaps, language))})
        begin = start
        for cut in [*cuts, stop]:
            end = cut
            while end > begin and text[end - 1].isspace():
                end -= 1
            if end > begin:
                out.append((begin, end))
            begin = cut
    return out


SCHEMA = "item_kind string, item_id string, sent_start bigint, sent_end bigint"


def dictionary(texts: DataFrame, most: int = MOST_WORDS, least: int = LEAST_OCCURRENCES) -> dict[str, dict[str, int]]:
    """The open-class words of the spaceless scripts in all ``texts`` (text), with their occurrences.

    Every run of a script is parted at the closed-class words. A part that occurs ``least`` times is a word; a part and
    the closed-class word beside it are one where most of the part's occurrences lie beside it and nothing but a border or
    a closed-class word comes beyond, for a true particle would go on to another word. Counting is an aggregate
    with partial sums; at most ``most`` words a language come to the driver, the most frequent ones, ties by the word.
    """
    text = F.col("text")
    kana, han, thai = text.rlike(f"[{_KANA}]"), text.rlike(f"[{_HAN}]"), text.rlike(f"[{_THAI}]")
    scripts = {"th": (thai, _THAI), "ja": (kana, _KANA + _HAN), "zh": (han & ~kana, _HAN)}

    def parts(language: str, script: str) -> Column:
        closed = sorted({w for w in closed_class(language) if re.fullmatch(f"[{script}]+", w)}, key=lambda w: (-len(w), w))
        either = "|".join(closed)
        found = F.regexp_extract_all(text, F.lit(f"{either}|(?:(?!{either})[{script}])+|[^{script}]+"), F.lit(0))
        # What a part is: of the closed class, a run of the script, other text, or (by its sides) a border of blanks or punctuation.
        kind = lambda w: F.when(w.isin(*closed), "closed").when(w.rlike(f"^[{script}]"), "run").otherwise("other")
        return F.transform(found, lambda w: F.struct(kind(w).alias("kind"), w.alias("word")))

    def words(language: str) -> Column:
        """(language, of, word) of every run in the column of the language and of what it grows together with."""
        at = lambda i: F.when(i >= 0, F.get(F.col(language), i))
        # A closed-class word grows together with a run only where the text doesn't go on with other words beyond it.
        ends = lambda x, border: F.coalesce((x["kind"] == "closed") | x["word"].rlike(border), F.lit(True))
        behind = lambda x, i: F.when((at(i - 1)["kind"] == "closed") & ends(at(i - 2), r"[\s\p{P}]$"), F.concat(at(i - 1)["word"], x["word"]))
        ahead = lambda x, i: F.when((at(i + 1)["kind"] == "closed") & ends(at(i + 2), r"^[\s\p{P}]"), F.concat(x["word"], at(i + 1)["word"]))
        each = F.transform(F.col(language), lambda x, i: F.when(x["kind"] == "run", F.transform(F.array(x["word"], behind(x, i), ahead(x, i)), lambda w: F.struct(F.lit(language).alias("language"), x["word"].alias("of"), w.alias("word")))))
        return F.flatten(F.filter(each, lambda e: e.isNotNull()))

    # One scan and one shuffle of the counts serve all scripts.
    parted = texts.filter(thai | kana | han).select(*(F.when(present, parts(k, script)).alias(k) for k, (present, script) in scripts.items()))
    each = parted.select(F.explode(F.concat(*(F.coalesce(words(k), F.array()) for k in scripts))).alias("w")).select("w.*").filter(F.length("word").between(2, LONGEST))
    counted = each.groupBy("language", "of", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    whole = F.max(F.when(F.col("of") == F.col("word"), F.col("n"))).over(Window.partitionBy("language", "of"))
    grown = counted.withColumn("whole", F.coalesce(whole, F.col("n"))).filter((F.col("of") == F.col("word")) | (F.col("n") >= GROWN * F.col("whole")))
    first = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    out: dict[str, dict[str, int]] = {k: {} for k in scripts}
    for language, word, n in grown.groupBy("language", "word").agg(F.max("n").alias("n")).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).select("language", "word", "n").collect():
        out[language][word] = n
    return out


def _splitter(gaps: Gaps):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [spans(t, gaps) for t in part.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = np.array([s for f in found for s in f], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["item_kind", "item_id", "sent_start", "sent_end"])

    return split


def sentences(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_kind, item_id, sent_start, sent_end) of chunks.text and claims.verbatim.

    Two passes: the dictionary, then the spans, made where the rows lie; repeated deliveries fall together in one
    aggregate over the few numbers of a span, so no text is shuffled.
    """
    own = lambda df, kind, text: df.filter(F.col("id").isNotNull() & F.col(text).isNotNull()).select(F.lit(kind).alias("item_kind"), F.col("id").cast("string").alias("item_id"), F.col(text).alias("text"))
    items = own(chunks, "chunk", "text").unionByName(own(claims, "claim", "verbatim"))
    return items.mapInArrow(_splitter(Gaps(dictionary(items.select("text")))), SCHEMA).distinct()
