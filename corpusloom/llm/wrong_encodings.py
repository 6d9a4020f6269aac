"""Garbled text from wrong character encoding.

Method: a text decoded with the wrong code page is a substitution cipher over its bytes: each symbol on the page
stands for one byte of the original. The swap is unknown per source, and several may occur in one.

1. The language: bigrams of the UTF-8 bytes of all texts of the usual characters (at most 65,536 counts). The same pass over
   the records writes those with unusual characters, the only ones that are looked at again.
2. E step, over the written records: the likelihood of each swap (page seen, true encoding) given the
   bigrams of what it would restore, against the text as it stands. A character strange to the language costs at most
   STRANGE, so that foreign words are no evidence by themselves; a replacement mark costs what it is worth.
3. M step, per source and swap: symbol bigrams, summed per task before the shuffle, re-estimate which byte each symbol
   stands for; EM against the byte bigrams of the true encoding, beginning at the code page's table, with every
   byte open for symbols that the page lacks. No two symbols get one byte, and a symbol leaves the table's byte, or gets one at all, only
   if the bigrams of records held out from the fit gain by it: so no text is restored worse than by the table. A group
   is an alphabet squared, whatever the number of records.
4. Texts that are strange throughout and fit none of the SWAPS are taken as of one unknown page per source: the tables of every one-byte
   page that Python knows, and a start by frequencies alone, are refined by EM and by exchanges of bytes; the best is
   taken if it reads the held-out records about as well as the language reads itself. Symbols it says nothing about stay as they are.
5. Records are deciphered with their source's mappings by translate(), and count as garbled if the gain exceeds LEAST.
   Text garbled twice is deciphered twice. Lost bytes (replacement marks) are found but not restored.

Pages of several bytes (CP932, EUC-JP) and seven-bit JIS have no single symbols to learn: they are re-encoded, and judged by the same
likelihood. Text read as a page of several bytes that is in neither list (GBK, Big5) is not covered.

Defined results: null and empty texts are not garbled; a null source is a source of its own; repeated rows are one
record; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import encodings.aliases
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import checkpoint, fresh_path, joined_hot, partitions

#: Code pages on which text may have been read, and true encodings that are no UTF-8.
BYTE_PAGES = ("cp1252", "mac_roman", "cp437", "koi8_r", "cp1251", "cp850")
WIDE_PAGES = ("cp932", "euc_jp")
SWAPS = [
    *((p, "utf-8") for p in BYTE_PAGES),
    *((p, "utf-8") for p in WIDE_PAGES),
    *((p, t) for p in BYTE_PAGES for t in ("cp932", "euc_jp")),
    ("cp932", "euc_jp"),
    ("euc_jp", "cp932"),
    ("7bit", "euc_jp"),
]
STRANGE = -8.0
RESTORED = -10.0
NEVER = -20.0
UNLIKELY = -6.0  # further cost of a strange character in what is restored
LEAST = {"utf-8": 4.0, "cp932": 10.0, "euc_jp": 10.0}
ROUNDS = 3
MOST_HELD = 500_000  # counts a task holds before it hands them on
EM_STEPS = 12
LEAST_SEEN, SURE = 5.0, 0.5  # a byte is learned for a symbol seen so often, and so surely
HELD_OUT = 4  # one record in so many tests what the others teach
LEAST_GAIN = 5.0  # by which the held-out bigrams of a symbol must gain
OWN = "own page"
ALL_STRANGE = 0.3  # share of unusual characters from which a text is strange throughout
LEAST_SYMBOLS = 1000  # of a source's unknown page
AS_GOOD = 0.7  # nats a bigram by which an unknown page may read worse than the language reads itself
STARTS, EXCHANGES = 8, 400
HOT_TEXTS = 2000  # doubtful texts of one source in one task

USUAL = re.compile(r"[\x00-\x7f\u3000-\u303fぁ-ヿ一-鿿！（），．：；？［］＿｜－／０-９Ａ-Ｚａ-ｚ“”‘’«»…―—–─・éèêàçùîôâûëïüœæÉÀÈÇÊŒÂÎÔ\xa0]*")
UNUSUAL = re.compile("[^" + USUAL.pattern[1:-1])
#: Usual characters in places where only a wrong decoding puts them: kanji inside a Latin word, seven-bit kana.
MISPLACED = re.compile(r"[A-Za-z][一-鿿]|[一-鿿][a-z]|[$%][!-~][^\n]{0,40}[$%][!-~]")
UTF8 = re.compile(r"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: A stretch of bytes that holds a high one; in EUC text all but ASCII are above a0.
STRETCH = {"cp932": re.compile(r"[\x80-\xff](?:[\x00-\xff]*[\x80-\xff])?[@-~]?"), "euc_jp": re.compile(r"[\xa1-\xfe](?:[\x20-\x7e\n\xa1-\xfe]*[\xa1-\xfe])?")}
SEVEN = re.compile(r"[!-~]{6,}")
KANA_OR_WIDE = re.compile("[ぁ-ゖ、。（）０-９Ａ-Ｚａ-ｚ]")
HALF_KANA = re.compile("[｡-ﾟ]")
NEVER_USED = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd\U000e0000-\U0010ffff]")


def suspicious(text: str | None) -> bool:
    return bool(text) and (USUAL.fullmatch(text) is None or MISPLACED.search(text) is not None)


def byte_bigrams(texts: list[str], encoding: str = "utf-8") -> np.ndarray:
    data = np.frombuffer("\n".join(texts).encode(encoding, "ignore"), np.uint8).astype(np.int64)
    return np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16) if len(data) > 1 else np.zeros(1 << 16, np.int64)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(second | first) of bytes, mixed with a thousandth of the uniform."""
    c = counts.reshape(256, 256).astype(float)
    p = c / np.maximum(c.sum(axis=1, keepdims=True), 1)
    return np.log(0.999 * p + 0.001 / 256 + 1e-12)


class Language:
    """Scores of texts under byte bigrams."""

    def __init__(self, counts: np.ndarray):
        self.logs = log_probabilities(counts)

    def per_character(self, text: str, floor: float) -> np.ndarray:
        data = np.frombuffer(b"\n" + text.encode("utf-8", "replace"), np.uint8)
        logs = self.logs[data[:-1], data[1:]]
        return np.maximum(np.add.reduceat(logs, np.flatnonzero((data[1:] & 0xC0) != 0x80)), floor)

    def score(self, text: str, floor: float = STRANGE) -> float:
        """Log-likelihood; a character costs at most the floor, those that no text uses cost NEVER."""
        if not text:
            return 0.0
        as_is = self.per_character(text, floor).sum()
        if floor == STRANGE and HALF_KANA.search(text):
            as_is = max(as_is, self.per_character(unicodedata.normalize("NFKC", text), floor).sum())
        return float(as_is + (NEVER - floor) * len(NEVER_USED.findall(text)))


class PageMap(dict):
    """For str.translate: symbol to byte; what the page lacks stays, out of the range of bytes."""

    def __missing__(self, c: int) -> int:
        out = self[c] = c if c < 0x80 or c > 0xFF else 0xF0000 + c
        return out


class WideMap(dict):
    """For str.translate: a character to its bytes on a page of several bytes."""

    def __init__(self, page: str):
        super().__init__()
        self.page = page

    def __missing__(self, c: int) -> str:
        try:
            out = chr(c).encode(self.page).decode("latin_1")
        except UnicodeEncodeError:
            out = chr(c) if 0x80 <= c <= 0xA0 else chr(0xF0000 + c) if c < 0x100 else chr(c)
        self[c] = out
        return out


@lru_cache(None)
def page_mapping(page: str) -> dict[int, int]:
    """Symbol to byte of a one-byte page; positions the page leaves open stand for themselves."""
    out: dict[int, int] = {b: b for b in range(0x80, 0x100)} if page == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(page))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


@lru_cache(None)
def wide_map(page: str) -> WideMap:
    return WideMap(page)


@lru_cache(None)
def page_map(page: str) -> PageMap:
    return PageMap(page_mapping(page))


def _utf8(m: re.Match) -> str:
    return m[0].encode("latin_1").decode("utf-8", "replace")


def decipher(text: str, swap: tuple[str, str], mapping: dict[int, int] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """The text as the swap would restore it, and its changed pieces (before, after), each with its neighbours."""
    page, true = swap
    out, changes, last = [], [], 0

    def put(start: int, end: int, fixed: str) -> None:
        nonlocal last
        if USUAL.fullmatch(text, start, end) and not USUAL.fullmatch(fixed):
            return
        out.extend((text[last:start], fixed))
        left, right = text[max(0, start - 1) : start], text[end : end + 1]
        changes.append((left + text[start:end] + right, left + fixed + right))
        last = end

    if page == "7bit":
        for m in SEVEN.finditer(text):
            if "$" in m[0]:
                put(m.start(), m.end(), bytes(ord(c) | 0x80 for c in m[0]).decode(true, "replace"))
    elif page not in WIDE_PAGES:
        coded = text.translate(PageMap(mapping) if mapping else page_map(page))
        for m in (UTF8 if true == "utf-8" else STRETCH[true]).finditer(coded):
            put(m.start(), m.end(), _utf8(m) if true == "utf-8" else m[0].encode("latin_1").decode(true, "replace"))
    else:
        # A character has one byte or two here; pieces are cut at characters.
        table = wide_map(page)
        coded = [c.translate(table) for c in text]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        data = "".join(coded)
        for m in (UTF8 if true == "utf-8" else STRETCH[true]).finditer(data):
            a, b = int(np.searchsorted(ends, m.start(), "right")), int(np.searchsorted(ends, m.end(), "left")) + 1
            if a < last:
                continue
            before, after = data[int(ends[a]) - len(coded[a]) : m.start()], data[m.end() : int(ends[b - 1])]
            if true == "utf-8":
                put(a, b, before + _utf8(m) + after)
            elif HALF_KANA.search(text[a:b]):
                fixed = m[0].encode("latin_1").decode(true, "replace")
                if len(KANA_OR_WIDE.findall(fixed)) * 6 >= len(fixed):
                    put(a, b, fixed)
    return "".join(out) + text[last:], changes


def gain_of(changes: list[tuple[str, str]], language: Language) -> float:
    before, after = "\n".join(x for x, _ in changes), "\n".join(x for _, x in changes)
    strange = len(UNUSUAL.findall(after))
    return language.score(after, RESTORED) - language.score(before) + UNLIKELY * strange


#: Pieces of a text: what lies between unusual characters is at most a few others.
PIECE = re.compile(UNUSUAL.pattern + "(?:.{0,8}" + UNUSUAL.pattern + ")*", re.S)


def likely_swaps(text: str, maps: dict, swaps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Swaps whose page has the strange characters of some piece of the text (nearly as many of them as any other page)."""
    pages = [s for s in swaps if s[0] not in WIDE_PAGES and s[0] != "7bit"]
    likely = set()
    for strange in {frozenset(ord(c) for c in m if c >= "\x80" and c != "\ufffd") for m in PIECE.findall(text)}:
        cover = {s: sum(c in (maps.get(s) or page_mapping(s[0])) for c in strange) for s in pages}
        most = max(cover.values(), default=0)
        likely |= {s for s in pages if cover[s] > 0 and cover[s] >= 0.8 * most}
    wide = bool(HALF_KANA.search(text) or NEVER_USED.search(text) or MISPLACED.search(text))
    return [s for s in swaps if s in likely or (wide if s[0] in WIDE_PAGES else s[0] == "7bit" and "$" in text)]


def best_swap(text: str, language: Language, maps: dict[tuple[str, str], dict[int, int]] | None = None, swaps=None) -> tuple[str, tuple[str, str] | None, float]:
    """(restored, swap, gain) of one round; None if no swap gains LEAST."""
    best = (text, None, 0.0)
    for swap in likely_swaps(text, maps or {}, swaps or SWAPS):
        mapping = (maps or {}).get(swap)
        fixed, changes = decipher(text, swap, mapping)
        if not changes:
            continue
        gain = gain_of(changes, language)
        if swap[1] == "utf-8" and swap[0] not in WIDE_PAGES:
            # Garbled twice: the first step alone need not read better.
            twice, more = decipher(fixed, swap, mapping)
            if more and (both := language.score(twice) - language.score(text)) > max(gain, best[2], LEAST["utf-8"]):
                best = (twice, swap, both)
        if gain > max(best[2], LEAST[swap[1]]):
            best = (fixed, swap, gain)
    return best


def restore(text: str, language: Language, maps=None, swaps=None) -> tuple[str, str | None, float]:
    """(restored text, swaps undone, gain); swaps is None for a text that isn't garbled."""
    undone, total = [], 0.0
    lost = text.count("\ufffd")
    for _ in range(1 if lost else ROUNDS):
        if undone and not suspicious(text):
            break
        text, swap, gain = best_swap(text, language, maps, swaps)
        if swap is None:
            break
        undone.append(">".join(swap))
        total += gain
    if lost:
        # What the mark replaced is unknown; any usual character explains the place better.
        undone.append("lost bytes")
        total += lost * (STRANGE - NEVER)
    return text, " ".join(undone) or None, total


class Bigrams:
    """Symbol bigrams (first, second, n) as a matrix over the symbols of two tables; code points below 128 are themselves."""

    def __init__(self, pairs: pd.DataFrame, symbols: list[int]):
        number = {s: k for k, s in enumerate(symbols)}
        known = pairs["first"].isin(number) & pairs["second"].isin(number)
        self.n = np.zeros((len(symbols), len(symbols)))
        np.add.at(self.n, (pairs["first"][known].map(number).astype(int), pairs["second"][known].map(number).astype(int)), pairs["n"][known])

    def by_byte(self, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """(symbol, byte): log-likelihood of the bigrams of each symbol, were it that byte and the others those of ``at`` (-1: none)."""
        known = np.flatnonzero(at >= 0)
        return self.n[:, known] @ logs[:, at[known]].T + self.n[known].T @ logs[at[known]]

    def score(self, at: np.ndarray, logs: np.ndarray) -> float:
        """Log-likelihood of the bigrams of known symbols; one with an unknown symbol is worth any byte."""
        out = np.full(self.n.shape, -np.log(256.0))
        known = np.flatnonzero(at >= 0)
        out[np.ix_(known, known)] = logs[np.ix_(at[known], at[known])]
        return float((self.n * out).sum())


def expectation_maximisation(n: np.ndarray, emit: np.ndarray, joint: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """(symbol, byte): how often each byte is expected to show as each symbol; emit is the start, joint the byte bigrams' probabilities."""
    for _ in range(steps):
        emit = emit / np.maximum(emit.sum(axis=0), 1e-300)
        after, before = joint @ emit.T, emit @ joint
        ratio = n / np.maximum(emit @ after, 1e-300)
        emit = emit * (ratio @ after.T + ratio.T @ before)
    return emit


def _joint(counts: np.ndarray) -> np.ndarray:
    joint = np.exp(log_probabilities(counts)) * (counts.reshape(256, 256).sum(axis=1, keepdims=True) + 1.0)
    return joint / joint.sum()


def _symbols(*pairs: pd.DataFrame) -> list[int]:
    return sorted(set().union(*[{*p["first"], *p["second"]} for p in pairs]))


def learn_mapping(pairs: pd.DataFrame, swap: tuple[str, str], language_counts: np.ndarray, held: pd.DataFrame | None = None) -> dict[int, int]:
    """Symbol to byte, where EM finds another than the page's table; pairs are symbol bigrams (first, second, n), held those of other records.

    A byte that another symbol of the texts holds is not given twice, and the held-out bigrams must gain LEAST_GAIN by each change.
    """
    held = pairs if held is None else held
    symbols = _symbols(pairs, held)
    table = page_mapping(swap[0])
    known = {s: s if s < 0x80 else table.get(s, -1) for s in symbols}
    at = np.array([known[s] for s in symbols])
    # emit[s, b]: how likely byte b shows as symbol s.
    emit = np.zeros((len(symbols), 256))
    for k, s in enumerate(symbols):
        emit[k, 0x80:] = 0.02 * (s >= 0x80)
        if at[k] >= 0:
            emit[k, at[k]] = 1
    expected = expectation_maximisation(Bigrams(pairs, symbols).n, emit, _joint(language_counts))
    total, best = expected.sum(axis=1), expected.argmax(axis=1)
    sure = (total >= LEAST_SEEN) & (expected.max(axis=1) >= SURE * total) & (best != at) & (np.array(symbols) >= 0x80)
    test, logs, out = Bigrams(held, symbols), log_probabilities(language_counts), {}
    for k in sorted(np.flatnonzero(sure), key=lambda k: -total[k]):
        if best[k] in at:
            continue
        gains, bigrams = test.by_byte(at, logs)[k], test.n[k, at >= 0].sum() + test.n[at >= 0, k].sum()
        before = gains[at[k]] if at[k] >= 0 else -bigrams * np.log(256.0)
        if gains[best[k]] - before > LEAST_GAIN:
            at[k] = out[symbols[k]] = int(best[k])
    return out


@lru_cache(None)
def all_pages() -> tuple[str, ...]:
    """Every one-byte page Python knows whose lower half is ASCII."""
    out, seen = [], set()
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            if bytes(range(0x20, 0x7F)).decode(name) == bytes(range(0x20, 0x7F)).decode("ascii") and len(bytes([0xE3, 0x81]).decode(name, "replace")) == 2 and "é".encode(name, "replace") != "é".encode():
                upper = bytes(range(0x80, 0x100)).decode(name, "replace")
                if len(upper) == 128 and upper not in seen and len(set(upper)) > 64:
                    seen.add(upper)
                    out.append(name)
        except (LookupError, UnicodeError, ValueError):
            continue
    return tuple(out)


def _one_to_one(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols that have no byte get the free one of most weight, heaviest first."""
    at, free = at.copy(), np.ones(256, bool)
    free[at[at >= 0]] = free[:0x80] = False
    for flat in np.argsort(-weights, axis=None, kind="stable"):
        k, b = divmod(int(flat), 256)
        if weights[k, b] <= 0:
            break
        if at[k] < 0 and free[b]:
            at[k], free[b] = b, False
    return at


def _exchanged(bigrams: Bigrams, at: np.ndarray, movable: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Bytes of two symbols exchanged, or a byte for a free one, as long as the likelihood grows."""
    score = bigrams.score(at, logs)
    for _ in range(EXCHANGES):
        by = bigrams.by_byte(at, logs)
        gain = by - by[np.arange(len(at)), np.maximum(at, 0)][:, None]
        gain[~movable] = -np.inf
        gain[:, :0x80] = -np.inf
        owner = np.full(256, -1)
        owner[at[at >= 0]] = np.flatnonzero(at >= 0)
        taken = np.flatnonzero(owner >= 0)
        gain[:, taken] += np.where(movable[owner[taken]], gain[owner[taken]][:, np.maximum(at, 0)].T, -np.inf)
        for flat in np.argsort(-gain, axis=None)[:20]:
            k, b = divmod(int(flat), 256)
            if not gain[k, b] > -1e3:
                continue
            trial = at.copy()
            if owner[b] >= 0:
                trial[owner[b]] = at[k]
            trial[k] = b
            if (now := bigrams.score(trial, logs)) > score + 1e-6:
                at, score = trial, now
                break
        else:
            break
    return at


def learn_page(pairs: pd.DataFrame, held: pd.DataFrame, counts: dict[str, np.ndarray]) -> tuple[str, dict[int, int]] | None:
    """(true encoding, symbol to byte) of a page that is in no list; None if nothing reads the held-out bigrams as the language."""
    symbols = _symbols(pairs, held)
    fit, test = Bigrams(pairs, symbols), Bigrams(held, symbols)
    upper = np.array(symbols) >= 0x80
    seen = np.where(upper, fit.n.sum(axis=0) + fit.n.sum(axis=1), 0)
    if seen.sum() < 2 * LEAST_SYMBOLS or not test.n.sum() or len(symbols) > 1024:
        return None
    # No page has more than 128 symbols; rarer ones are foreign to it.
    upper &= seen >= np.sort(seen)[-min(128, len(seen))]
    best = None
    for true, c in counts.items():
        total = c.sum()
        if not total or (best is not None and best[0] < AS_GOOD / 2):
            continue
        logs, joint, random = log_probabilities(c), _joint(c), np.random.default_rng(0)
        ascii_only = np.where(np.array(symbols) < 0x80, symbols, -1)
        starts = []
        for page in all_pages():
            table = page_mapping(page)
            at = np.array([s if s < 0x80 else table.get(s, -1) for s in symbols])
            if seen[at < 0].sum() <= 0.1 * seen.sum():
                starts.append((at, at, 0))
        starts = sorted(starts, key=lambda x: -fit.score(x[0], logs))[:3]
        # A start without a table: symbols and bytes of like frequency.
        often = np.log(np.maximum(seen / seen.sum(), 1e-9))[:, None]
        usual = np.log(np.maximum(joint.sum(axis=0)[None, :] / joint[:, 0x80:].sum(), 1e-9))
        starts += [(ascii_only, None, noise) for noise in range(STARTS)]
        for at, table, noise in starts:
            emit = np.zeros((len(symbols), 256))
            emit[np.arange(len(symbols)), np.maximum(at, 0)] = at >= 0
            if table is None:
                emit[:, 0x80:] = np.where(upper[:, None], np.exp(-np.abs(often - usual) + 0.3 * min(noise, 1) * random.standard_normal((len(symbols), 256))), 0)[:, 0x80:]
            else:
                emit[:, 0x80:] += 0.02 * upper[:, None]
            expected = expectation_maximisation(fit.n, emit, joint, 60 if table is None else EM_STEPS)
            found = _exchanged(fit, _one_to_one(np.where(upper[:, None], expected, 0), at), upper, logs)
            own = float((c.reshape(256, 256) * logs).sum() / total)
            loss = own - test.score(found, logs) / test.n.sum()
            if best is None or loss < best[0]:
                best = (loss, true, found)
    if best is None or best[0] > AS_GOOD:
        return None
    return best[1], {s: int(b) for s, b, n in zip(symbols, best[2], seen) if s >= 0x80 and b >= 0 and n >= LEAST_SEEN}


# Spark


ENCODINGS = ("utf-8", "cp932", "euc_jp")
READ = "record_table string, record_id string, source string, text string, encoding string, pair long, n long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suspicious records as they are, and byte bigrams of the others, per true encoding."""
    sums = {e: np.zeros(1 << 16, np.int64) for e in ENCODINGS}
    for pdf in batches:
        odd = np.fromiter(map(suspicious, pdf["text"]), bool, len(pdf))
        usual = [t for t in pdf["text"][~odd] if t]
        for e, s in sums.items():
            s += byte_bigrams(usual, e)
        yield pdf[odd].assign(encoding=None, pair=0, n=0)
    for e, s in sums.items():
        at = np.flatnonzero(s)
        yield pd.DataFrame({"record_table": None, "record_id": None, "source": None, "text": None, "encoding": e, "pair": at, "n": s[at]})


def _collected(rows: DataFrame) -> dict[str, np.ndarray]:
    """Byte bigrams per true encoding: at most 3 * 65,536 numbers come to the driver."""
    sums = rows.where("encoding is not null").groupBy("encoding", "pair").agg(F.sum("n").alias("n")).toPandas()
    out = {e: np.zeros(1 << 16, np.int64) for e in ENCODINGS}
    for e, part in sums.groupby("encoding"):
        out[e][part["pair"].to_numpy()] = part["n"].to_numpy()
    return out


def _expect(batches: Iterator[pd.DataFrame], language: Language) -> Iterator[pd.DataFrame]:
    """E step: each record's best swap, as bigrams of its symbols; one record in HELD_OUT is marked as held out."""
    sums: dict[tuple, np.ndarray] = {}
    size = 0

    def put(source: str, swap: str, held: bool, keys: np.ndarray) -> None:
        nonlocal size
        sums.setdefault((source, swap, held), []).append(keys)
        size += len(keys)

    for pdf in batches:
        for source, text, held in zip(pdf["source"], pdf["text"], pdf["held"]):
            _, swap, _ = best_swap(text, language)
            if swap is None and "\ufffd" not in text and len(UNUSUAL.findall(text)) >= ALL_STRANGE * len(text):
                points = np.array([ord(c) for c in text], np.int64)
                put(source, OWN, held, points[:-1] << 32 | points[1:])
            elif swap is not None and swap[0] in BYTE_PAGES:
                # Every swap of a source is known by one pair at least; of texts garbled twice the bytes are no language.
                put(source, ">".join(swap), held, np.array([10 << 32 | 10], np.int64))
                if suspicious(decipher(text, swap)[0]):
                    continue
                # Symbols are the page's and strange ones; other characters of a text that is garbled in part are none.
                table = page_mapping(swap[0])
                symbol = np.array([c < "\x80" or ord(c) in table or not USUAL.fullmatch(c) for c in text])
                points = np.array([ord(c) for c in text], np.int64)
                at = np.flatnonzero(symbol[:-1] & symbol[1:] & ((points[:-1] >= 0x80) | (points[1:] >= 0x80)))
                put(source, ">".join(swap), held, points[at] << 32 | points[at + 1])
        if size > MOST_HELD:
            yield _emissions(sums)
            sums, size = {}, 0
    yield _emissions(sums)


def _emissions(sums: dict[tuple, list[np.ndarray]]) -> pd.DataFrame:
    parts = []
    for (source, swap, held), keys in sums.items():
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        parts.append(pd.DataFrame({"source": source, "swap": swap, "held": held, "first": key >> 32, "second": key & 0xFFFFFFFF, "n": n}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["source", "swap", "held", "first", "second", "n"])


def _maximise(pdf: pd.DataFrame, counts: dict[str, np.ndarray]) -> pd.DataFrame:
    """M step of one source and swap: the symbols whose byte differs from the page's table, or the whole of an unknown page."""
    source, swap = pdf["source"].iloc[0], pdf["swap"].iloc[0]
    fit, held = pdf[~pdf["held"]], pdf[pdf["held"]]
    if swap == OWN:
        learned = learn_page(fit, held, counts)
        if learned is None:
            return pd.DataFrame({"source": [], "swap": [], "symbols": [], "bytes": []})
        swap, found = f"{OWN}>{learned[0]}", learned[1]
    else:
        two = tuple(swap.split(">"))
        found = learn_mapping(fit, two, counts[two[1]], held) if len(fit) and len(held) else {}
    return pd.DataFrame({"source": [source], "swap": [swap], "symbols": [list(found)], "bytes": [list(found.values())]})


def _mapping(swap: tuple[str, str], symbols, found) -> dict[int, int]:
    """The page's table with what the source taught; a byte given anew is no longer the table's symbol's."""
    new = {int(s): int(b) for s, b in zip(symbols, found)}
    table = {} if swap[0] == OWN else page_mapping(swap[0])
    given = set(new.values())
    return {s: b for s, b in table.items() if b not in given} | new


def _decide(batches: Iterator[pd.DataFrame], language: Language) -> Iterator[pd.DataFrame]:
    known: dict[str, dict] = {}
    for pdf in batches:
        out = []
        for table, rid, source, text, maps in zip(pdf["record_table"], pdf["record_id"], pdf["source"], pdf["text"], pdf["maps"]):
            if source not in known:
                known = {source: {(s := tuple(m["swap"].split(">"))): _mapping(s, m["symbols"], m["bytes"]) for m in maps}}
            own = known[source]
            # The swaps learned for the source; those that are no cipher over single symbols have nothing to learn.
            swaps = [s for s in own if s not in SWAPS] + [s for s in SWAPS if s in own or s[0] not in BYTE_PAGES]
            fixed, undone, gain = restore(text, language, own, swaps)
            if undone is not None:
                out.append((table, rid, undone, gain, fixed))
        yield pd.DataFrame(out, columns=["record_table", "record_id", "swaps", "gain", "restored"])


def garbled(records: DataFrame) -> DataFrame:
    """(record_table, record_id, swaps, gain, restored) of garbled records; records has record_table, record_id, source, text."""
    spark = records.sparkSession
    rows = records.select("record_table", "record_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("record_id is not null and text is not null")
    path = fresh_path(spark, "suspicious")
    rows.mapInPandas(_read, READ).write.parquet(path)
    read = spark.read.schema(READ).parquet(path)
    counts = _collected(read)
    language = Language(counts["utf-8"])
    shared = spark.sparkContext.broadcast((language, counts))
    doubtful = read.where("encoding is null").select("record_table", "record_id", "source", "text")
    # The written files are few: spread over the tasks by record, so that no source is one task's.
    spread = doubtful.withColumn("held", F.pmod(F.xxhash64("record_id"), F.lit(HELD_OUT)) == 0).repartition(partitions(spark), "record_id")
    pairs = spread.select("source", "text", "held").mapInPandas(lambda it: _expect(it, shared.value[0]), "source string, swap string, held boolean, first long, second long, n long")
    summed = pairs.groupBy("source", "swap", "held", "first", "second").agg(F.sum("n").alias("n"))
    learned = (
        summed.repartition(partitions(spark), "source", "swap")
        .groupBy("source", "swap")
        .applyInPandas(lambda pdf: _maximise(pdf, shared.value[1]), "source string, swap string, symbols array<long>, bytes array<long>")
    )
    # At most one mapping per swap and source, most of them empty; a source of many records is spread in the join.
    maps = learned.groupBy("source").agg(F.collect_list(F.struct("swap", "symbols", "bytes")).alias("maps"))
    sources = doubtful.groupBy("source").agg(F.count("*").alias("n")).join(maps, "source", "left")
    sources = checkpoint(sources.select("source", "n", F.coalesce("maps", F.array().cast(maps.schema["maps"].dataType)).alias("maps")))
    return (
        joined_hot(doubtful, sources, ["source"], "record_id", HOT_TEXTS)
        .select("record_table", "record_id", "source", "text", "maps")
        # The join's partitions are few bytes, but much work.
        .repartition(partitions(spark), "record_id")
        .sortWithinPartitions("source")
        .mapInPandas(lambda it: _decide(it, shared.value[0]), "record_table string, record_id string, swaps string, gain double, restored string")
    )


def records_of(source_chunks: DataFrame, work_editions: DataFrame) -> DataFrame:
    chunks = source_chunks.select(F.lit("source_chunks").alias("record_table"), F.col("chunk_id").alias("record_id"), F.col("source_id").alias("source"), "text")
    fields = [
        work_editions.select(F.lit("work_editions").alias("record_table"), F.col("edition_id").alias("record_id"), F.lit(f"work_editions.{f}").alias("source"), F.col(f).alias("text"))
        for f in ("text_encoding", "text_charset")
    ]
    return chunks.unionByName(fields[0]).unionByName(fields[1])


def garbled_records(source_chunks: DataFrame, work_editions: DataFrame) -> DataFrame:
    return garbled(records_of(source_chunks, work_editions)).select("record_table", "record_id").distinct()
