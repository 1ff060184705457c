"""Benchmark decontamination through a distributed positional inverted index.

The training documents are indexed in segments of bounded size. A segment is
one row: its documents, its terms, and for each term the sorted positions at
which it stands, delta-coded. A query phrase is searched in every segment by
itself: its terms' position lists are shifted by the terms' offsets in the
phrase and intersected, from the segment's rarest term on. So exact matches
need no shuffle, no pair of documents is ever formed, and a lost executor
costs the segments it was working on.

Positions run through a whole segment with a gap between documents, so no
match crosses a document's end.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.llm.common import fresh, materialize, release

#: Words of a window.
WINDOW = 13
#: Bytes of text after which a segment is closed; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Bytes of benchmark text that one pass searches; more are searched in further passes.
BLOCK_BYTES = 2 << 20

_WORD_CHARS = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TO_WORDS = bytes(c if c in _WORD_CHARS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_bytes(text: str | None) -> bytes:
    """A text's words, and a blank for each byte between them. Null: none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased; runs of digits, letters and all
    characters beyond ASCII. Null: none."""
    return word_bytes(text).split()


@dataclass
class Segment:
    """Inverted lists of some documents."""

    term_no: dict[bytes, int]
    starts: np.ndarray  # of each term's list in positions, and the end
    positions: np.ndarray
    base: np.ndarray  # first position of each document
    n_words: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Document number of each position."""
        return np.searchsorted(self.base, at, side="right") - 1


def index_texts(texts: list[str | None], vocabulary: set[bytes] | None, gap: int) -> Segment:
    """Index texts, all terms or those of a vocabulary. ``gap``: positions
    left free after each document, more than any phrase is long."""
    term_no: dict[bytes, int] = defaultdict() if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))}
    if vocabulary is None:
        term_no.default_factory = term_no.__len__  # a new term gets the next number
    ids, base, n_words, at = [], [], [], 0
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(term_no.get, words, [-1] * len(words)) if vocabulary is not None else map(term_no.__getitem__, words), dtype=np.int32, count=len(words)))
        base.append(at)
        n_words.append(len(words))
        at += len(words) + gap
    if ids:
        flat = np.concatenate(ids)
        where = np.concatenate([np.arange(b, b + k, dtype=np.int64) for b, k in zip(base, n_words, strict=True)])
        known = flat >= 0
        flat, where = flat[known], where[known]
    else:
        flat, where = np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    term_no = dict(term_no)
    starts = np.zeros(len(term_no) + 1, dtype=np.int64)
    np.cumsum(np.bincount(flat, minlength=len(term_no)), out=starts[1:])
    return Segment(term_no, starts, where[order], np.array(base, dtype=np.int64), np.array(n_words, dtype=np.int64))


def pack_lists(seg: Segment) -> tuple[list[bytes], bytes, bytes]:
    """Terms that occur, their list lengths and their delta-coded positions,
    seven bits a byte."""
    lengths = seg.lengths
    used = np.flatnonzero(lengths)
    names = sorted(seg.term_no, key=seg.term_no.__getitem__)
    terms = [names[i] for i in used]
    delta = np.diff(seg.positions, prepend=0)
    heads = seg.starts[:-1][used]
    delta[heads] = seg.positions[heads]
    return terms, lengths[used].astype("<i4").tobytes(), encode_varints(delta)


def encode_varints(x: np.ndarray) -> bytes:
    x = x.astype(np.uint64)
    if not len(x):
        return b""
    size = np.ones(len(x), dtype=np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(end[-1], dtype=np.uint8)
    for k in range(int(size.max())):
        has = size > k
        part = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[end[has] - size[has] + k] = part.astype(np.uint8) | more
    return out.tobytes()


def decode_varints(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), dtype=np.uint64)
    size = last - first + 1
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (b[first[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def unpack_lists(terms: list[bytes], lengths: bytes, packed: bytes, base: np.ndarray, n_words: np.ndarray) -> Segment:
    sizes = np.frombuffer(lengths, dtype="<i4").astype(np.int64)
    starts = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    delta = decode_varints(packed)
    total = np.cumsum(delta)
    before = np.where(starts[:-1] > 0, total[starts[:-1] - 1], 0) if len(sizes) else np.zeros(0, np.int64)
    positions = total - np.repeat(before, sizes)
    return Segment({t: i for i, t in enumerate(terms)}, starts, positions, base, n_words)


@dataclass
class Phrases:
    """Distinct phrases of one block of test items, and who has them."""

    words: list[tuple[bytes, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    @property
    def vocabulary(self) -> set[bytes]:
        return {w for p in self.words for w in p}


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; a shorter text is one window, an empty none."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def phrase_blocks(items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The test items' phrases in blocks of bounded size, read one after the
    other; at least one block. A null item id is written as an empty string."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    used, any_yet = 0, False
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        for p in windows_of(words_of(r["text"]), size):
            found.setdefault(p, set()).add(r["i"] or "")
        used += len(r["text"] or "")
        if used >= block_bytes:
            yield Phrases(list(found), [sorted(x) for x in found.values()])
            found, used, any_yet = {}, 0, True
    if found or not any_yet:
        yield Phrases(list(found), [sorted(x) for x in found.values()])


def _member(sorted_list: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, x)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == x if len(sorted_list) else np.zeros(len(x), dtype=bool)


def find_exact(seg: Segment, phrases: list[tuple[bytes, ...]]) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase number, start positions) for the phrases that occur."""
    lengths = seg.lengths
    get = seg.term_no.get
    for no, phrase in enumerate(phrases):
        terms = [get(w, -1) for w in phrase]
        if -1 in terms:
            continue
        order = sorted(range(len(terms)), key=lambda k: lengths[terms[k]])
        if not lengths[terms[order[0]]]:
            continue
        starts = seg.list_of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            starts = starts[_member(seg.list_of(terms[k]), starts + k)]
        if len(starts):
            yield no, starts


def spans_near(seg: Segment, phrase: tuple[bytes, ...], slop: int) -> np.ndarray:
    """Rows (first, end): the shortest span from each start that holds the
    words of the phrase, in any order and as often as the phrase has them, in
    at most len(phrase) + slop words of one document; a span starts at one of
    the words. The lists are read only near the rarest word's positions."""
    need = Counter(phrase)
    none = np.zeros((0, 2), dtype=np.int64)
    if not need or any(w not in seg.term_no for w in need):
        return none
    reach = len(phrase) + slop
    lists = sorted(((seg.list_of(seg.term_no[w]), n) for w, n in need.items()), key=lambda x: len(x[0]))
    rare = lists[0][0]
    if any(len(lst) < n for lst, n in lists):
        return none
    # a span starts at most reach - 1 before a place of the rarest word
    cand = []
    for lst, _ in lists:
        lo, hi = np.searchsorted(lst, rare - reach, side="right"), np.searchsorted(lst, rare, side="right")
        size = hi - lo
        cand.append(lst[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)])
    first = np.unique(np.concatenate(cand))
    end = first.copy()
    for lst, n in lists:
        last = np.searchsorted(lst, first) + n - 1
        ok = last < len(lst)
        first, last = first[ok], last[ok]
        end = np.maximum(end[ok], lst[last] + 1)
        ok = end - first <= reach
        first, end = first[ok], end[ok]
    ok = seg.locate(first) == seg.locate(end - 1)
    return np.stack([first[ok], end[ok]], axis=1)


def find_near(seg: Segment, phrase: tuple[bytes, ...], slop: int) -> np.ndarray:
    """First positions of the spans of :func:`spans_near`."""
    return spans_near(seg, phrase, slop)[:, 0]


def spans_of(starts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Union of runs, as rows (first, end) in ascending order."""
    if not starts:
        return np.zeros((0, 2), dtype=np.int64)
    lo = np.concatenate([s for s, _ in starts])
    hi = np.concatenate([s + k for s, k in starts])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return np.stack([lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1]], axis=1)


def search(seg: Segment, block: Phrases) -> list[tuple[list[int], list[str]]]:
    """For each document of a segment: its hit spans, flattened, relative to
    the document, and the ids of the items that occur in it."""
    hits, owners = [], [set() for _ in seg.base]
    for no, starts in find_exact(seg, block.words):
        hits.append((starts, len(block.words[no])))
        for d in np.unique(seg.locate(starts)).tolist():
            owners[d].update(block.items[no])
    out: list[tuple[list[int], list[str]]] = [([], []) for _ in seg.base]
    spans = spans_of(hits)
    for d, (lo, hi) in zip(seg.locate(spans[:, 0]).tolist(), (spans).tolist(), strict=True):
        b = int(seg.base[d])
        out[d][0].extend((lo - b, hi - b))
    return [(flat, sorted(own)) for (flat, _), own in zip(out, owners, strict=True)]


def _join(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> tuple[list[int], list[str]]:
    """Union of what two blocks found in a document."""
    if not b[0]:
        return a[0], a[1]
    rows = np.array(a[0] + b[0], dtype=np.int64).reshape(-1, 2)
    spans = spans_of([(rows[i : i + 1, 0], int(rows[i, 1] - rows[i, 0])) for i in range(len(rows))])
    return spans.ravel().tolist(), sorted({*a[1], *b[1]})


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<int>, hit_items array<string>"


def verdicts(n_words: np.ndarray, found: list[tuple[list[int], list[str]]]) -> pd.DataFrame:
    rows = []
    for n, (flat, items) in zip(n_words.tolist(), found, strict=True):
        hit = sum(flat[1::2]) - sum(flat[::2])
        rows.append((n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n, flat, items))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def _cut(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters, or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, size: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of ``docs``: one row a segment, with doc_ids, n_words, terms,
    list_lengths and lists. ``vocabulary`` keeps only those terms' lists."""
    gap = size + 1

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list = []
        held = 0
        for b in batches:
            for i, t in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist(), b["text"].tolist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= segment_bytes:
                    yield row(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield row(ids, texts)

    def row(ids: list, texts: list) -> pd.DataFrame:
        seg = index_texts(texts, vocabulary, gap)
        terms, lengths, lists = pack_lists(seg)
        return pd.DataFrame({"doc_ids": [[None if i is None else int(i) for i in ids]], "n_words": [seg.n_words.tolist()], "terms": [terms], "list_lengths": [lengths], "lists": [lists]})

    schema = "doc_ids array<bigint>, n_words array<bigint>, terms array<binary>, list_lengths binary, lists binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(build, schema)


def load_segment(n_words: list[int], terms: list[bytes], lengths: bytes, lists: bytes, size: int = WINDOW) -> Segment:
    n = np.array(n_words, dtype=np.int64)
    base = np.zeros(len(n), dtype=np.int64)
    np.cumsum(n[:-1] + size + 1, out=base[1:])
    return unpack_lists([bytes(t) for t in terms], lengths, lists, base, n)


NEAR = "doc_id bigint, item_id string, first bigint, end bigint"


def search_near(index: DataFrame, blocks: Iterable[Phrases], slop: int, size: int = WINDOW) -> DataFrame:
    """Columns of NEAR: each span of an indexed document that holds the words
    of a phrase of the item within ``slop`` words more than it has."""
    sc = index.sparkSession.sparkContext

    def one(sent: Broadcast) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    seg = load_segment(list(r.n_words), list(r.terms), r.list_lengths, r.lists, size)
                    found: set[tuple[int, str, int, int]] = set()
                    for phrase, items in zip(sent.value.words, sent.value.items, strict=True):
                        spans = spans_near(seg, phrase, slop)
                        for d, (lo, hi) in zip(seg.locate(spans[:, 0]).tolist(), spans.tolist(), strict=True):
                            at = int(seg.base[d])
                            found.update((d, i, lo - at, hi - at) for i in items)
                    out = pd.DataFrame(sorted(found), columns=["doc_id", "item_id", "first", "end"])
                    ids = [None if i is None or i != i else int(i) for i in r.doc_ids]
                    yield out.assign(doc_id=pd.array([ids[d] for d in out["doc_id"]], dtype="Int64"))

        return run

    out = index.sparkSession.createDataFrame([], NEAR)
    for block in blocks:  # each of bounded size: see BLOCK_BYTES; stored, so that only one is held
        sent = sc.broadcast(block)
        out = out.unionByName(materialize(index.mapInPandas(one(sent), NEAR), "near"))
        sent.destroy()
    return out


def search_index(index: DataFrame, blocks: Iterable[Phrases], size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Verdict on every indexed document: doc_id, and the columns of RESULT.
    With ``slop``, the proximity matches instead: see :func:`search_near`.

    Every block is a pass over the segments' rows that adds what it finds to
    them. All passes but the first read what the one before has stored; so
    driver and tasks hold two blocks at most, and nothing is joined.
    """
    if slop is not None:
        return search_near(index, blocks, slop, size)
    sc = index.sparkSession.sparkContext
    columns = index.columns
    rows = index.withColumn("found", F.lit("[]"))

    def one(sent: Broadcast) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    seg = load_segment(list(r.n_words), list(r.terms), r.list_lengths, r.lists, size)
                    now = search(seg, sent.value)
                    before = json.loads(r.found)
                    out.append(json.dumps([_join(x, y) for x, y in zip(before, now, strict=True)] if before else now))
                yield b.assign(found=out)

        return run

    schema = rows.schema
    sent = held = None
    for block in blocks:  # each of bounded size: see BLOCK_BYTES
        if sent is not None:
            stored = materialize(rows, "searched", "zstd")
            sent.destroy()
            if held is not None:
                release(held)
            rows = held = stored
        sent = sc.broadcast(block)
        rows = rows.mapInPandas(one(sent), schema)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                out = verdicts(np.array(r.n_words, dtype=np.int64), json.loads(r.found))
                out.insert(0, "doc_id", pd.array([None if i is None or i != i else int(i) for i in r.doc_ids], dtype="Int64"))
                yield out

    return rows.select("found", *[c for c in columns if c in ("doc_ids", "n_words")]).mapInPandas(tell, "doc_id bigint, " + RESULT)


def annotate(docs: DataFrame, blocks: Iterable[Phrases], out_col: str, text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with a struct of RESULT: the same segments and search, made
    and used in place without being stored. For stages that keep whole rows."""
    sc = docs.sparkSession.sparkContext

    def one(sent: Broadcast) -> Callable:
        @F.pandas_udf("string")
        def judged(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            vocabulary = sent.value.vocabulary
            for s, before in texts:
                all_texts, out = s.tolist(), []
                for lo, hi in _cut(all_texts, SEGMENT_BYTES):
                    seg = index_texts(all_texts[lo:hi], vocabulary, size + 1)
                    for n, now, old in zip(seg.n_words.tolist(), search(seg, sent.value), before[lo:hi], strict=True):
                        out.append(json.dumps([n, *(_join(json.loads(old)[1:], now) if old else now)]))
                yield pd.Series(out, dtype=object)

        return judged

    @F.pandas_udf(RESULT)
    def told(found: pd.Series) -> pd.DataFrame:
        rows = [json.loads(x) for x in found]
        return verdicts(np.array([r[0] for r in rows], dtype=np.int64), [r[1:] for r in rows])

    found = F.lit("")
    for block in blocks:
        found = one(sc.broadcast(block))(F.col(text), found)
    return docs.withColumn(out_col, told(found))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Verdict on every document: doc_id, and the columns of RESULT.

    A document word inside any occurrence of an item's window is hit; a
    document is contaminated if hits are a twentieth of its words or more.
    Null and empty texts have no words and are clean; so is everything if no
    item has words. Repeated rows and items count as they stand; null ids
    stay null. A very long text is a segment of its own, read whole. Matches
    are sets, so there are no ties; an empty table gives no rows. Only doc_id,
    item_id and text are read, so other columns cannot clash. hit_spans:
    first and end of each run of hit words in turn.

    The index, of all terms, is stored in the shared folder.
    """
    index = materialize(build_index(docs, None, size), "postings", "zstd")
    return search_index(index, phrase_blocks(items, size), size)


def proximity(docs: DataFrame, items: DataFrame, slop: int, size: int = WINDOW) -> DataFrame:
    """Proximity matches of the items' windows in the documents: columns of
    NEAR, by the same stored index as :func:`decontaminate`. Where an item's
    windows are in two blocks, both may find one span: it then stands twice."""
    index = materialize(build_index(docs, None, size), "postings", "zstd")
    return search_index(index, phrase_blocks(items, size), size, slop)


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows; all columns kept, nothing shuffled."""
    (found,) = fresh(docs, "decontamination")
    judged = annotate(docs, phrase_blocks(items, size), found, size=size)
    return judged.filter(~F.col(found)["contaminated"]).drop(found)
