"""Finding and restoring text that was decoded with the wrong character encoding.

A hidden Markov model labels characters. It has a clean state, one state for each
pair of a text's true encoding and the one it was read with, and one for characters
that were lost. A state of a pair reads one character, or as many as one character
of UTF-8 became, and emits the character that they stood for; the likelihood of an
emission is that of the character behind the one emitted before, under a bigram
model of the corpus. States are sticky and are left for the clean one only. The
most likely path over a whole page labels each of its characters, within words
too, and each labelled span gets its state's inverse transform.

ASCII is written alike by all states, so that only characters beyond it can change
the state, and what lies between two ASCII characters can be worked out once for
each different string.

The character model (bigrams, backed off to character classes) counts all pages
and whole texts; a bigram counts once a page, so that a garbled page that repeats
itself counts once. What can be read as UTF-8 is left out of the counts, as it is
more often garbled than not.

Characters beyond ASCII count alike whether they stand as such or as HTML
entities; a restored passage takes the place of its entities, all else stays as
it is stored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.sources.tables import materialise

#: A bigram on fewer of the pages counts as not seen.
LEAST_SHARE = 0.008
#: Log probabilities, at each character beyond ASCII: leaving the clean state for a one-byte pair, staying with a pair and going back.
LEAVE, STAY, BACK = math.log(2e-6), math.log(0.95), math.log(0.05)
#: Leaving it for UTF-8 read as one-byte characters, which chance seldom makes valid, or for lost characters.
LEAVE_MULTI = math.log(1e-2)
#: A character that a state cannot have written, beside its likelihood where it is clean.
NOISE = -10.0
#: A lost character where the state is clean: correct text has none.
LOST_IN_CLEAN = -40.0
LOST = "lost"
NEVER = -1e18
_WORD = re.compile('[ \t\r\n<>"]+')
_ENTITY = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_PIECE = re.compile(f"{_ENTITY.pattern}|.", re.S)

#: Pairs of true encoding and encoding that the text was read with.
MULTI = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2"]
SINGLE = [
    ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1254", "cp1252"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp866", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "mac_roman"), ("cp866", "cp1251"),
]


@lru_cache(64)
def byte_of(encoding: str) -> dict[int, int]:
    """Character -> byte of a one-byte encoding; bytes that it leaves open stand for the control character of that number."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


@lru_cache(64)
def char_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in ((chr(c), b) for c, b in byte_of(encoding).items())}


@lru_cache(1 << 12)
def _opened_entity(entity: str) -> str:
    """The character beyond ASCII that an entity stands for; else the entity itself."""
    c = html.unescape(entity)
    if c.isascii() or len(c) > 1 or c == "\ufffd" and entity.lower().strip("&#;").lstrip("0") not in ("65533", "xfffd"):
        return entity
    return c


def opened(word: str) -> str:
    """The word with its entities beyond ASCII as characters."""
    return _ENTITY.sub(lambda m: _opened_entity(m.group()), word) if "&" in word else word


TWICE = ("cp1252", "latin-1")
MULTI_STATES = {f"utf-8 as {w}": (w, 1) for w in MULTI} | {f"utf-8 twice as {w}": (w, 2) for w in TWICE}
STATES = [*MULTI_STATES, *[f"{true} as {wrong}" for true, wrong in SINGLE], LOST]
#: Wrong encodings in which correct text hardly ever looks like UTF-8; the others put accents beside quotes or letters there.
UNLIKELY = [f"utf-8 as {w}" for w in MULTI if w not in ("mac_roman", "koi8_r", "cp866")]


def _leads() -> dict[str, list[str]]:
    """Character -> the states in which it begins a character of UTF-8."""
    found: dict[str, list[str]] = {}
    for state, (wrong, _) in MULTI_STATES.items():
        for code, byte in byte_of(wrong).items():
            if 0xC2 <= byte <= 0xF4:
                found.setdefault(chr(code), []).append(state)
    return found


def _changes() -> dict[str, list[tuple[str, str]]]:
    """Character -> (state, what stands for it) of the one-byte pairs that change it."""
    found: dict[str, list[tuple[str, str]]] = {}
    for true, wrong in SINGLE:
        table = char_of(true)
        for code, byte in byte_of(wrong).items():
            if table[byte] != chr(code):
                found.setdefault(chr(code), []).append((f"{true} as {wrong}", table[byte]))
    return found


LEADS, CHANGES = _leads(), _changes()


def _sequence(chars: list[str], at: int, table: dict[int, int]) -> tuple[int, str] | None:
    """(length, character) of the UTF-8 character that begins at `at`, where there is one."""
    lead = table.get(ord(chars[at]), 0)
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if not 0xC2 <= lead <= 0xF4 or at + size > len(chars):
        return None
    raw = bytearray([lead])
    for c in chars[at + 1 : at + size]:
        byte = table.get(ord(c), 0)
        if not 0x80 <= byte <= 0xBF:
            return None
        raw.append(byte)
    try:
        return size, raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def unit(chars: list[str], at: int, state: str) -> tuple[int, str] | None:
    """(length, character) of what a UTF-8 state reads at `at`, where it can read something."""
    wrong, times = MULTI_STATES[state]
    table = byte_of(wrong)
    if times == 1:
        return _sequence(chars, at, table)
    once: list[str] = []
    size, need = 0, None
    while need is None or len(once) < need:
        found = _sequence(chars, at + size, table) if at + size < len(chars) else None
        if found is None:
            return None
        size += found[0]
        once.append(found[1])
        if need is None:
            lead = table.get(ord(found[1]), 0)
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    found = _sequence(once, 0, table)
    return (size, found[1]) if found is not None else None


def pieces(word: str) -> tuple[list[str], list[str]]:
    """(stored, characters): the word's characters, as they are stored and with entities beyond ASCII read."""
    if "&" not in word:
        chars = list(word)
        return chars, chars
    stored = _PIECE.findall(word)
    read = [_opened_entity(p) if len(p) > 1 else p for p in stored]
    if any(len(c) > 1 for c in read):  # entities that stay are ASCII text
        stored = [x for p, c in zip(stored, read) for x in (p if len(c) > 1 else (p,))]
        read = [x for c in read for x in c]
    return stored, read


def _leave(state: str) -> float:
    return LEAVE_MULTI if state in MULTI_STATES or state == LOST else LEAVE


@lru_cache(1 << 16)
def char_class(c: str) -> str:
    """Kind and script of a character, the classes of the back-off model."""
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else "s" if c == " " else "p"
    kind = unicodedata.category(c)
    if kind in ("Cc", "Co", "Cn"):
        return "control"
    if kind[0] != "L":
        return "box" if "─" <= c <= "◿" else "mark" if "‐" <= c <= "›" or c in "\xa0\xa9\xab\xbb\xb7" else "sign"
    script = unicodedata.name(c, "?").split(" ")[0]
    latin = "1" if c <= "\xff" else "2"
    return f"{script}{latin if script == 'LATIN' else ''}{'u' if kind == 'Lu' else 'l'}"


def words_of(text: str) -> list[str]:
    """The strings between ASCII white space, quotes and tags that hold a character or entity beyond ASCII, in order, as stored."""
    if text.isascii() and "&" not in text:
        return []
    return [w for w in _WORD.split(text) if not opened(w).isascii()]


@lru_cache(1 << 17)
def word_bigrams(word: str) -> frozenset[str]:
    """The bigrams of a word and its borders that hold a character beyond ASCII, without those of what may be garbled UTF-8."""
    chars = pieces(word)[1]
    doubtful = set()
    for i, c in enumerate(chars):
        for state in LEADS.get(c, ()):
            if state in UNLIKELY and (found := unit(chars, i, state)):
                doubtful.update(range(i, i + found[0]))
    padded = [" ", *chars, " "]
    return frozenset(
        x + y for i, (x, y) in enumerate(zip(padded, padded[1:])) if (x >= "\x80" or y >= "\x80") and i not in doubtful and i - 1 not in doubtful
    )


def page_statistics(text: str) -> set[str]:
    return set().union(*map(word_bigrams, words_of(text)))


class CharModel:
    """P(next character | character) from the numbers of pages that hold each bigram.

    counts: (kind, key) -> number: 'b' a bigram that is kept as seen, 'f' and 'c' the
    bigrams that begin and end with a character, 'x' those between two classes
    (joined by a blank). Only 'b' is cut, so what is kept is bounded by the number
    of characters and by 1 / LEAST_SHARE times the bigrams of a page.
    """

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.kept, self.first, self.char = ({k: n for (kind, k), n in counts.items() if kind == want} for want in "bfc")
        self.pair, self.pair_first, self.of_class, self.size = {}, {}, {}, {}
        for (kind, key), n in counts.items():
            if kind == "x":
                x, y = key.split(" ")
                self.pair[x, y] = n
                self.pair_first[x] = self.pair_first.get(x, 0) + n
                self.of_class[y] = self.of_class.get(y, 0) + n
        for c in self.char:
            y = char_class(c)
            self.size[y] = self.size.get(y, 0) + 1
        self.known: dict[str, float] = {}

    @classmethod
    def of_pages(cls, pages: list[str]) -> CharModel:
        """The model of a few pages in memory."""
        seen: Counter = Counter()
        for page in pages:
            seen.update(page_statistics(page))
        return cls(with_kinds({("b", b): n for b, n in seen.items()}, LEAST_SHARE * len(pages)))

    def cost(self, before: str, char: str) -> float:
        """Log probability of a character behind another; 0 between two of ASCII, which all states share."""
        if before < "\x80" and char < "\x80":
            return 0.0
        bigram = before + char
        if (found := self.known.get(bigram)) is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            found = self.known[bigram] = self._cost(before, char)
        return found

    def _cost(self, before: str, char: str) -> float:
        x, y = char_class(before), char_class(char)
        to_class = (self.pair.get((x, y), 0) + 0.02) / (self.pair_first.get(x, 0) + 1)
        in_class = (self.char.get(char, 0) + 0.1) / (self.of_class.get(y, 0) + 0.1 * (self.size.get(y, 0) + 50))
        seen = self.kept.get(before + char, 0) / (self.first.get(before, 0) + 1)
        return math.log(0.9 * seen + 0.1 * to_class * in_class + 1e-9)


def with_kinds(bigrams: dict[tuple[str, str], int], least: float) -> dict[tuple[str, str], int]:
    """The counts of CharModel from those of all bigrams ('b', bigram)."""
    counts = {k: n for k, n in bigrams.items() if n >= max(2, least)}
    for (_, b), n in bigrams.items():
        for key in _derived(b):
            counts[key] = counts.get(key, 0) + n
    return counts


@lru_cache(1 << 17)
def _derived(bigram: str) -> tuple[tuple[str, str], ...]:
    return ("f", bigram[0]), ("c", bigram[1]), ("x", f"{char_class(bigram[0])} {char_class(bigram[1])}")


class Word:
    """What a word does to a path, beside reading it as clean: best scores from and to each state, by which the word can be read."""

    __slots__ = ("high", "through", "into", "out", "around")

    def __init__(self, high: int):
        self.high = high
        self.through: dict[str, float] = {}
        self.into: dict[str, float] = {}
        self.out: dict[str, float] = {}
        self.around: tuple[float, str | None] = (0.0, None)


class Labeller:
    """The most likely states of a page; each different word is worked out once and kept."""

    def __init__(self, model: CharModel):
        self.model = model
        self.word = lru_cache(1 << 17)(self._word)

    def _units(self, chars: list[str]) -> dict[str, dict[int, tuple[int, str]]]:
        """state -> place -> (length, character) of what it reads there, for states that change a character."""
        found: dict[str, dict[int, tuple[int, str]]] = {}
        for i, c in enumerate(chars):
            if c < "\x80":
                continue
            for state, becomes in CHANGES.get(c, ()):
                found.setdefault(state, {})[i] = (1, becomes)
            for state in LEADS.get(c, ()):
                if read := unit(chars, i, state):
                    found.setdefault(state, {})[i] = read
            if c == "\ufffd":
                found.setdefault(LOST, {})[i] = (1, c)
        for state, own in found.items():
            if state not in MULTI_STATES and state != LOST:
                table = byte_of(state.rpartition(" as ")[2])
                for i, c in enumerate(chars):  # what the pair leaves as it is
                    if c >= "\x80" and i not in own and ord(c) in table:
                        own[i] = (1, c)
        return found

    def _clean(self, before: str, c: str) -> float:
        return self.model.cost(before, c) + (LOST_IN_CLEAN if c == "\ufffd" else 0.0)

    def _paths(self, chars: list[str], state: str, units: dict[int, tuple[int, str]], entered: bool, trace: bool = False):
        """Viterbi of the clean state and one other over a word, from the other where `entered`: (ends clean, ends in the state[, steps])."""
        cost, n, lost = self.model.cost, len(chars), state == LOST
        leave = _leave(state)
        clean, other, last = [NEVER] * (n + 1), [NEVER] * (n + 1), [" "] * (n + 1)
        (other if entered else clean)[0] = 0.0
        steps: list[dict] = [{} for _ in range(n + 1)] if trace else []
        for i, c in enumerate(chars):
            v, w = clean[i], other[i]
            if v == NEVER and w == NEVER:
                continue
            before, seen = chars[i - 1] if i else " ", last[i]
            beyond = c >= "\x80"
            # to clean
            stay, back = v + self._clean(before, c), (w + BACK + self._clean(seen, c)) if beyond else NEVER
            if max(stay, back) > clean[i + 1]:
                clean[i + 1] = max(stay, back)
                if trace:
                    steps[i + 1][None] = (i, None if stay >= back else state)
            # to the state
            if not beyond:
                if w + cost(seen, c) > other[i + 1]:
                    other[i + 1], last[i + 1] = w + cost(seen, c), c
                    if trace:
                        steps[i + 1][state] = (i, state)
                continue
            read = units.get(i)
            if read is None:
                size, becomes, fresh, kept = 1, c, NEVER, w + STAY + NOISE + self._clean(seen, c)
            else:
                size, becomes = read
                emit = (lambda x: 0.0) if lost else (lambda x, y=becomes: cost(x, y))
                fresh, kept = v + leave + emit(before), w + STAY + emit(seen)
            if max(fresh, kept) > other[i + size]:
                other[i + size], last[i + size] = max(fresh, kept), becomes
                if trace:
                    steps[i + size][state] = (i, None if fresh >= kept else state)
        clean[n] += cost(chars[-1], " ")
        other[n] += 0.0 if lost else cost(last[n], " ")
        return (clean[n], other[n], steps) if trace else (clean[n], other[n])

    def _word(self, word: str) -> Word:
        chars = pieces(word)[1]
        out = Word(sum(c >= "\x80" for c in chars))
        units = self._units(chars)
        if not units:
            return out
        padded = [" ", *chars, " "]
        clean = sum(map(self._clean, padded, padded[1:]))
        for state, own in units.items():
            a, b = self._paths(chars, state, own, False)
            c, d = self._paths(chars, state, own, True)
            out.into[state], out.out[state], out.through[state] = b - clean, c - clean, d - clean
            if a - clean > out.around[0] + 1e-9:
                out.around = (a - clean, state)
        return out

    def _walk(self, words: list[str], trace: list | None = None) -> tuple[float, str | None]:
        """(score beside all clean, last state) of the best path; with `trace`, what each word adds for backtracking."""
        at_clean, others = 0.0, {}
        for word in words:
            w = self.word(word)
            if not others and not w.into and trace is None:
                continue
            best, source = at_clean + w.around[0], None
            now, came = {}, {}
            for s, v in others.items():
                through, out = w.through.get(s, w.high * (STAY + NOISE)), w.out.get(s, BACK)
                now[s], came[s] = v + through, s
                if v + out > best:
                    best, source = v + out, s
            for s, gain in w.into.items():
                if at_clean + gain > now.get(s, NEVER):
                    now[s], came[s] = at_clean + gain, None
            if trace is not None:
                trace.append((source, came))
            at_clean = best
            # a state that is no better than leaving for it again later can be dropped
            others = {s: v for s, v in now.items() if v > at_clean + _leave(s) - 1e-9}
        last = max(others, key=others.get, default=None)
        return (others[last], last) if last is not None and others[last] > at_clean else (at_clean, None)

    def garbled(self, words: list[str]) -> bool:
        return self._walk(words)[0] > 1e-6

    def label(self, words: list[str]) -> list[tuple[str | None, str | None]]:
        """The states in which the path enters and leaves each word, None for clean."""
        trace: list = []
        _, state = self._walk(words, trace)
        found = []
        for source, came in reversed(trace):
            before = source if state is None else came[state]
            found.append((before, state))
            state = before
        return found[::-1]

    def spans(self, word: str, before: str | None, after: str | None) -> list[tuple[int, int, str | None, str]]:
        """(start, end, state, character) of what is read at a time, over the characters of a word."""
        chars = pieces(word)[1]
        state = before or after or self.word(word).around[1]
        if state is None:
            return [(i, i + 1, None, c) for i, c in enumerate(chars)]
        units = self._units(chars).get(state, {})
        steps = self._paths(chars, state, units, before is not None, True)[2]
        out, at, now = [], len(chars), after
        while at:
            start, source = steps[at][now]
            read = units.get(start) if now is not None else None
            out.append((start, at, now if read else None, read[1] if read else chars[start]))
            at, now = start, source
        return out[::-1]

    def restore(self, text: str) -> tuple[str, list[str]]:
        """The text with each labelled span's inverse transform, and the states used, in order of appearance; lost characters stay."""
        words = words_of(text)
        labels = iter(self.label(words))
        used: list[str] = []

        def put(m: re.Match) -> str:
            word = m.group()
            if opened(word).isascii():
                return word
            before, after = next(labels)
            stored, parts = pieces(word)[0], []
            for start, end, state, becomes in self.spans(word, before, after):
                changed = state is not None and chars_of(stored, start, end) != becomes
                if (changed or state == LOST) and state not in used:
                    used.append(state)
                parts.append(becomes if changed and state != LOST else "".join(stored[start:end]))
            return "".join(parts)

        return re.sub('[^ \t\r\n<>"]+', put, text), used


def chars_of(stored: list[str], start: int, end: int) -> str:
    return "".join(_opened_entity(p) if len(p) > 1 else p for p in stored[start:end])


#: Different bigrams that a task counts before it passes them on.
FLUSH = 200_000


def fit_model(pages: DataFrame) -> CharModel:
    """The character model of (id, text), from the bigrams of all rows, counted with map-side combining.

    What reaches the driver: the numbers of each character and pair of classes, and
    the bigrams on at least LEAST_SHARE of the pages.
    """

    def count(batches):
        seen: Counter = Counter()

        def rows():
            all_counts: Counter = Counter()
            for b, n in seen.items():
                if b:
                    all_counts["b", b] += n
                    for key in _derived(b):
                        all_counts[key] += n
                else:
                    all_counts["p", ""] += n
            keys = list(all_counts)
            return pa.record_batch(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([k.encode("utf-8", "surrogatepass") for _, k in keys], pa.binary()), pa.array(list(all_counts.values()), pa.int64())], names=["kind", "key", "n"]
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(page_statistics(t))
                seen[""] += 1
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    rows = beyond_ascii(pages).select("text").mapInArrow(count, "kind string, key binary, n long")
    totals = materialise(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    n_pages = totals.where("kind = 'p'").agg(F.sum("n")).first()[0] or 0
    least = max(2.0, LEAST_SHARE * n_pages)
    found = totals.where((F.col("kind").isin("f", "c", "x")) | ((F.col("kind") == "b") & (F.col("n") >= least))).collect()
    return CharModel({(r["kind"], bytes(r["key"]).decode("utf-8", "surrogatepass")): r["n"] for r in found})


def beyond_ascii(pages: DataFrame) -> DataFrame:
    """The rows whose text holds a character or entity that may lie beyond ASCII."""
    return pages.where((F.octet_length("text") > F.length("text")) | F.col("text").rlike(_ENTITY.pattern))


def label_pages(pages: DataFrame, restore: bool = False) -> DataFrame:
    """(id) of (id, text): the rows with at least one garbled passage; with `restore` also states (in order of appearance), complete and text.

    complete is false where lost characters remain. Null and empty texts, and those
    without a character or entity beyond ASCII, are never garbled. Rows that repeat are labelled each time.
    """
    model = fit_model(pages)
    counts = {(kind, k): n for kind, own in zip("bfc", (model.kept, model.first, model.char)) for k, n in own.items()} | {("x", f"{x} {y}"): n for (x, y), n in model.pair.items()}
    shared = pages.sparkSession.sparkContext.broadcast(counts)  # bounded, see CharModel

    def run(batches):
        labeller = Labeller(CharModel(shared.value))
        for batch in batches:
            ids, states, complete, texts = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if not words or not labeller.garbled(words):
                    continue
                ids.append(i)
                if restore:
                    text, used = labeller.restore(t)
                    states.append(used)
                    complete.append(LOST not in used)
                    texts.append(text)
            if restore:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(states, pa.list_(pa.string())), pa.array(complete, pa.bool_()), pa.array(texts, pa.string())], names=["id", "states", "complete", "text"])
            else:
                yield pa.record_batch([pa.array(ids, pa.int64())], names=["id"])

    schema = "id long" + (", states array<string>, complete boolean, text string" if restore else "")
    return beyond_ascii(pages).select("id", "text").mapInArrow(run, schema)
