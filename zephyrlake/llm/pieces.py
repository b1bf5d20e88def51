"""SentencePiece encoding with seeded merge-dropout, and decoding, over a merge-type (BPE) model.

The model file gives pieces and scores. A text gets a space in front; spaces become the
model's mark for them, and the text falls into runs that no piece crosses (a run of spaces with the word
after it). In each run adjacent symbols whose join is a piece are candidates on an agenda, best score
first, then leftmost. Each candidate that comes up is skipped with probability `dropout`, which a keyed
hash of (seed, the row's id, the run's place in the text, how many came up in the run before) decides:
occurrences of a word vary by themselves, in a text and between texts, while the same input gives the same pieces
on any executor and after any retry. What stays no piece is spelled in bytes. With dropout 0 the result is the
model's own encoding.

The agendas of all runs of some texts are worked off together: runs of equal length are the rows of a matrix, and
each step takes the best candidate of every row, draws its skip, and merges or strikes it out. Nothing is
remembered between runs, so memory is bounded by `letters`, the letters that are worked on at a time; longer texts
are cut where runs begin. Runs of more than SHORT letters have an agenda of their own, a heap.

Decoding joins pieces and bytes and takes the space in front away: the text comes back exactly,
with runs of spaces, line feeds and unknown letters. The mark for spaces itself, where a text has it, is
spelled in bytes, so it stays apart from spaces.

Defined results: null and empty texts have no pieces and decode to the empty text; rows of equal id and text
get equal pieces; a row without id is keyed by its text; an empty table gives no rows; a very long text is encoded
whole, in parts. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import in_small_batches, read, releasing

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A symbol for the mark where a text itself has it: two characters, so no piece of a text's single ones.
LITERAL = "\x00" + SPACE
MASK = (1 << 64) - 1
#: Runs of so many letters have their agenda as a row of a matrix.
SHORT = 48
#: Skips of a long run are drawn for so many candidates at a time.
DRAWN = 1 << 18
#: Symbols: ids of pieces, from LETTER on code points that are no piece, then LITERAL and GONE.
SYMBOL_BITS = 22
LETTER = 1 << 21
LITERAL_SYMBOL, GONE = LETTER + 0x110000, (1 << SYMBOL_BITS) - 1
NO_RANK = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Dropout:
    """Chance that a candidate merge is skipped; seed; letters that are worked on at a time (about)."""

    dropout: float = 0.1
    seed: int = 20
    letters: int = 500_000


def skips(key, runs, nth, bar: int) -> np.ndarray:
    """Is the nth candidate (from 0) of each run, by its place in the text, left out? key: of the text; bar: of 2**64."""
    return _under(np.asarray(runs, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(key, np.uint64), nth, bar)


def _under(run_key: np.ndarray, nth, bar: int) -> np.ndarray:
    x = run_key + np.asarray(nth, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31) < np.uint64(min(bar, MASK))


class Pieces:
    """A model's pieces, the agenda and the way back. model: the model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.cost = {names[i]: -sp.get_score(i) for i in plain}
        self.id = {names[i]: i for i in plain}
        self.unknown = sp.unk_id()
        self.out: list[str | int] = [""] * n
        for i in plain:
            self.out[i] = names[i].replace(SPACE, " ")
        for b, i in self.bytes_.items():
            self.out[i] = b
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.cut_lines = self.cut_spaces and not any("\n" in p and len(p) > 1 for p in self.id)
        self.runs = re.compile(r" +[^ \n]*|[^ \n]+|\n+" if self.cut_lines else r" +[^ ]*|[^ ]+" if self.cut_spaces else r"[\s\S]+")
        self.pair: dict[int, tuple[int, int]] | None = None
        self._letters()
        self._joins()

    def _letters(self) -> None:
        """The symbol of each code point."""
        self.letter = np.arange(LETTER, LITERAL_SYMBOL, dtype=np.int32)
        for name, i in self.id.items():
            if len(name) == 1:
                self.letter[ord(name)] = i
        self.letter[ord(" ")], self.letter[ord(SPACE)] = self.letter[ord(SPACE)], LITERAL_SYMBOL

    def _symbol(self, name: str) -> int:
        """Of a piece or letter of the model's own names; GONE for what is neither."""
        return self.id.get(name, LETTER + ord(name) if len(name) == 1 else GONE)

    def _joins(self) -> None:
        """An open-addressed table of the pairs of symbols whose join is a piece: key, rank of its cost, its symbol."""
        ranks = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = {}
        for name, i in self.id.items():
            for k in range(1, len(name)):
                a, b = self._symbol(name[:k]), self._symbol(name[k:])
                if a != GONE and b != GONE:
                    pairs[a << SYMBOL_BITS | b] = (ranks[self.cost[name]], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.shift = np.uint64(64 - max(10, int(np.ceil(np.log2(3 * len(keys) + 1)))))
        size = 1 << 64 - int(self.shift)
        self.keys, self.rank, self.join = np.full(size + 1, -1, np.int64), np.full(size + 1, NO_RANK, np.int32), np.full(size + 1, GONE, np.int32)
        for at, key in zip(self._slot(keys).tolist(), keys.tolist(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at] = key
            self.rank[at], self.join[at] = pairs[key]
        self.none = size  # the slot of pairs that join to nothing

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair in the table."""
        keys = a.astype(np.int64) << SYMBOL_BITS | b
        at = self._slot(keys)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.none - 1)
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        at[self.keys[at] != keys] = self.none
        return at

    def run_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where runs begin, as the pattern `runs` cuts texts: points are the code points of texts that begin at first."""
        starts = np.zeros(len(points), bool)
        starts[first] = True
        if self.cut_spaces:
            space = points == 32
            starts[1:] |= space[1:] & ~space[:-1]
            if self.cut_lines:
                line = points == 10
                starts[1:] |= (line[1:] != line[:-1])
        return np.flatnonzero(starts)

    def work(self, sym: np.ndarray, starts: np.ndarray, run_key: np.ndarray, bar: int) -> None:
        """Works off the agendas of the runs that begin at starts, in place: a run's symbols come first in its place, GONE fills the rest."""
        sizes = np.diff(starts, append=len(sym))
        slot = self.joins(sym[:-1], sym[1:]) if len(sym) > 1 else np.empty(0, np.int64)
        order = np.argsort(sizes, kind="stable")
        of = sizes[order]
        for size in np.unique(of).tolist():
            rows = order[np.searchsorted(of, size) : np.searchsorted(of, size, "right")]
            if size > SHORT:
                for r in rows.tolist():
                    at = int(starts[r])
                    sym[at : at + size] = self._long(sym[at : at + size].tolist(), int(run_key[r]), bar)
            elif size > 1:
                self._short(sym, slot, starts[rows], size, run_key[rows], bar)

    def _short(self, sym: np.ndarray, slot: np.ndarray, at: np.ndarray, size: int, run_key: np.ndarray, bar: int) -> None:
        """Agendas of runs of one size: a row of symbols each, and of the slots and ranks of neighbours' joins."""
        where = at[:, None] + np.arange(size)
        s = np.full((len(at), size + 1), GONE, np.int32)
        s[:, :-1] = sym[where]
        j = np.full((len(at), size + 1), self.none, np.int32)
        j[:, : size - 1] = slot[where[:, :-1]]
        r = self.rank[j]
        column, came = np.arange(size), 0
        while True:
            best = r.argmin(1)
            row = np.arange(len(r))
            live = r[row, best] < NO_RANK
            if not live.all():
                done = ~live
                sym[at[done, None] + column] = s[done, :-1]
                at, run_key, s, j, r, best = at[live], run_key[live], s[live], j[live], r[live], best[live]
                if not len(at):
                    return
                row = np.arange(len(r))
            skip = _under(run_key, came, bar) if bar else np.zeros(len(r), bool)
            came += 1
            if skip.any():
                r[row[skip], best[skip]] = NO_RANK
                best[skip] = size  # nothing moves
            x = row[~skip]
            k = best[x]
            joined = self.join[j[x, k]]
            move = column + (column > best[:, None])
            s[:, :-1] = np.take_along_axis(s, move, 1)
            move = column + (column >= best[:, None])
            j[:, :-1] = np.take_along_axis(j, move, 1)
            r[:, :-1] = np.take_along_axis(r, move, 1)
            s[x, k] = joined
            # a joined symbol's neighbours: the pair that it begins, and the pair that it ends
            new = self.joins(joined, s[x, k + 1])
            j[x, k], r[x, k] = new, self.rank[new]
            y = k > 0
            x, k = x[y], k[y] - 1
            new = self.joins(s[x, k], joined[y])
            j[x, k], r[x, k] = new, self.rank[new]

    def _long(self, sym: list[int], run_key: int, bar: int) -> list[int]:
        """The agenda of one long run as a heap."""
        if self.pair is None:
            there = np.flatnonzero(self.keys != -1)
            self.pair = dict(zip(self.keys[there].tolist(), zip(self.rank[there].tolist(), self.join[there].tolist(), strict=True), strict=True))
        n, pair, came, draws = len(sym), self.pair.get, 0, b""
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(j[0], i, sym[i], sym[i + 1], j[1]) for i in range(n - 1) if (j := pair(sym[i] << SYMBOL_BITS | sym[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b, joined = heapq.heappop(agenda)
            k = after[i]
            if k >= n or sym[i] != a or sym[k] != b:
                continue
            if bar and came % DRAWN == 0:
                draws = _under(np.uint64(run_key), np.arange(came, came + DRAWN if n > DRAWN else came + 3 * n), bar).tobytes()
            came += 1
            if bar and draws[(came - 1) % DRAWN]:
                continue
            sym[i], sym[k] = joined, GONE
            after[i] = m = after[k]
            if m < n:
                before[m] = i
                if j := pair(joined << SYMBOL_BITS | sym[m]):
                    heapq.heappush(agenda, (j[0], i, joined, sym[m], j[1]))
            if (m := before[i]) >= 0 and (j := pair(sym[m] << SYMBOL_BITS | joined)):
                heapq.heappush(agenda, (j[0], m, sym[m], joined, j[1]))
        left = [x for x in sym if x != GONE]
        return left + [GONE] * (n - len(left))

    def spelled(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many come before each symbol and after the last): symbols without a piece in bytes, GONE in nothing."""
        count = (sym != GONE).astype(np.int64)
        odd = np.flatnonzero((sym >= LETTER) & (sym != GONE))
        kinds, of = np.unique(sym[odd], return_inverse=True)
        spelling = [
            [self.bytes_.get(b, self.unknown) for b in (SPACE if k == LITERAL_SYMBOL else chr(k - LETTER)).encode("utf-8", "surrogatepass")]
            for k in kinds.tolist()
        ]
        if len(odd):
            count[odd] = np.array([len(x) for x in spelling])[of]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = np.repeat(sym, count)
        for k, x in enumerate(spelling):
            at = upto[odd[of == k]]
            for n, i in enumerate(x):
                ids[at + n] = i
        return ids, upto

    def decode(self, ids) -> str:
        out, parts, raw = self.out, [], bytearray()
        for i in ids:
            p = out[i]
            if p.__class__ is int:
                raw.append(p)
            else:
                if raw:
                    parts.append(raw.decode("utf-8", "surrogatepass"))
                    raw.clear()
                parts.append(p)
        parts.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


@lru_cache(maxsize=2)
def of_model(model: bytes) -> Pieces:
    """Of a model's bytes, once in a Python worker."""
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load(path: str) -> Pieces:
    return of_model(read_model(path))


class Encoder:
    """Encodes texts, some letters at a time."""

    def __init__(self, pieces: Pieces, cfg: Dropout):
        self.pieces, self.cfg, self.bar = pieces, cfg, int(cfg.dropout * (1 << 64))

    def key(self, text: str, row: int | None) -> int:
        import xxhash

        name = text.encode("utf-8", "surrogatepass") if row is None else b"%d" % row
        return xxhash.xxh64_intdigest(name, self.cfg.seed * 2 + (row is None) & MASK)

    def encode(self, text: str | None, row: int | None = 0) -> list[int]:
        """The text's ids; row: what else the skips are keyed by, None for the text itself."""
        return self.encode_all([text], [row])[0].tolist()

    def encode_all(self, texts: list[str | None], rows: list[int | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, letters = lo, 0
            while hi < len(texts) and (hi == lo or letters + len(texts[hi] or "") <= self.cfg.letters):
                letters += len(texts[hi] or "") + 1
                hi += 1
            out += self._some(texts[lo:hi], rows[lo:hi])
            lo = hi
        return out

    def _some(self, texts: list[str | None], rows: list[int | None]) -> list[np.ndarray]:
        whole = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *map(len, whole)])
        if not len(points):
            return [np.empty(0, np.int32) for _ in texts]
        some = [k for k, t in enumerate(texts) if t]
        starts = self.pieces.run_starts(points, first[some])
        runs = np.diff(np.searchsorted(starts, first[[*some, len(texts)]]))
        keys = np.array([self.key(texts[k], rows[k]) for k in some], np.uint64)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(runs) - runs, runs)
        run_key = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(keys, runs)
        ids, before = [], [np.zeros(1, np.int64)]
        at = 0
        while at < len(starts):  # a text of more letters in parts, between runs
            to = max(
                at + 1, int(np.searchsorted(starts, starts[at] + self.cfg.letters, "right")) - 1
            ) if len(points) - starts[at] > self.cfg.letters else len(starts)
            end = int(starts[to]) if to < len(starts) else len(points)
            sym = self.pieces.letter[points[starts[at] : end]]
            self.pieces.work(sym, starts[at:to] - starts[at], run_key[at:to], self.bar)
            made, upto = self.pieces.spelled(sym)
            ids.append(made)
            before.append(before[-1][-1] + upto[1:])
            at = to
        ids, before = np.concatenate(ids), np.concatenate(before)
        return np.split(ids, before[first[1:-1]])


def _ids_column(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, cfg: Dropout | None = None) -> DataFrame:
    """(id, ids, n_pieces, lossless) of each row's whole text; lossless: decoding the ids gave the text back.

    The driver reads the model file, and executors get its bytes.
    """
    cfg, held = cfg or Dropout(), docs.sparkSession.sparkContext.broadcast(read_model(model))  # a vocabulary: a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = of_model(held.value)
        e = Encoder(pieces, cfg)
        for b in batches:
            for at in range(0, len(b), 256):  # ids of few rows at a time
                c = b.slice(at, 256)
                rows, texts = c.column("id").to_pylist(), c.column("text").to_pylist()
                ids = e.encode_all(texts, rows)
                ok = [pieces.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.column("id"), _ids_column(ids), pa.array(list(map(len, ids)), pa.int64()), pa.array(ok)],
                    ["id", "ids", "n_pieces", "lossless"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(releasing(run), "id long, ids array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """rows with text_col: the text of each row's ids."""
    held = rows.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        pieces = of_model(held.value)
        return ids.map(lambda x: pieces.decode(x) if x is not None else "")

    return rows.withColumn(text_col, run(F.col(ids_col)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
