"""Splitting oversized texts at natural boundaries (problem 9): byte ranges with halos, stitched boundaries, prefix sums, pieces by offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.llm.tokens import DEFAULT, Sizes, ship_vocabulary, sizes
from webobs.runtime import stage

CUTS = ("inside a word", "word", "sentence", "line", "paragraph")
LEAST = 4  # tokens that hold any single character
RANGE, HALO = 1 << 16, 1 << 12  # bytes
PIECE = "doc_id long, piece_no long, start long, end long, n_tokens long, cut string, text string"

# Where pieces of the tokenizer certainly end, by level: behind the blanks of a paragraph's or line's end (less a last
# space, which belongs to the next piece), behind a sentence's or a word's end, between a letter or digit and anything else.
_CERTAIN = [
    (4, re.compile(r"\n[^\S\n]*\n\s*(?=\S)")), (3, re.compile(r"\n\s*(?=\S)")),
    (2, regex.compile(r"[.!?…:;](?=\s)|[。！？；](?=[\p{L}\p{N}\s])")), (1, re.compile(r"\S(?=\s)")), (0, regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})")),
]


def natural_start(head: str) -> tuple[int, int]:
    """(offset, level) of the first best certain boundary in a halo; (0, -1) where there is none: a run goes through it."""
    for level, p in _CERTAIN:
        if m := p.search(head):
            at = m.end()
            return (at - 1, level) if level >= 3 and head[at - 1] == " " else (at, level)
    return 0, -1


def units(text: str, after: str, size: Sizes, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, tokens, 1 where its end is inside a piece of the tokenizer, else 0) of the units of a text that `after` follows.

    A unit is a piece of the tokenizer, so tokens of units add up exactly. A piece of more than an eighth of the limit (or 32
    tokens) is cut at the ends of its tokens that are ends of characters.
    """
    pieces = size.pieces(text + after[:2])
    if after:
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        k = int(np.searchsorted(ends, len(text), "right"))
        pieces = pieces[:k] if len(text) == (ends[k - 1] if k else 0) else size.pieces(text)
    t = np.fromiter(map(size.__getitem__, pieces), np.int64, len(pieces))
    c = np.fromiter(map(len, pieces), np.int64, len(pieces))
    large = np.flatnonzero(t > max(1, min(32, most // 8)))
    if not len(large):
        return c, t, np.zeros(len(c), np.int8)
    cs, ts, ins, at = [], [], [], 0
    for k in large:
        raw = np.frombuffer(pieces[k].encode(), np.uint8)
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters that begin before each byte
        ends = np.cumsum(size.width[size.code.encode_ordinary(pieces[k])])
        whole = np.r_[(raw & 0xC0) != 0x80, True][ends]
        n, e = np.flatnonzero(whole) + 1, ends[whole]
        cs += [c[at:k], np.diff(np.r_[0, chars[e]])]
        ts += [t[at:k], np.diff(np.r_[0, n])]
        ins += [np.zeros(k - at, np.int8), np.r_[np.ones(len(e) - 1, np.int8), np.int8(0)]]
        at = k + 1
    return np.concatenate([*cs, c[at:]]), np.concatenate([*ts, t[at:]]), np.concatenate([*ins, np.zeros(len(c) - at, np.int8)])


class Packer:
    """Cuts one text, or a block of one, that is fed in order; holds no more than the open piece and what was fed last."""

    def __init__(self, most: int, overlap: int, size: Sizes, at: int = 0):
        self.most, self.overlap, self.size = most, min(overlap, most // 2), size
        self.text, self.at = "", at  # the held text and where it begins
        self.c, self.t, self.ins = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.fresh = 0  # units of the held text that are in a piece already
        self.inside = False  # whether the held text begins inside a piece of the tokenizer
        self.end = "end"  # what the end of all that is fed is

    def feed(self, text: str, u: tuple[np.ndarray, np.ndarray, np.ndarray], hard: bool = False) -> None:
        """hard: the text ends inside a run that goes on in the next text fed."""
        self.text += text
        if hard and len(u[2]):
            u[2][-1] = 2
        self.c, self.t, self.ins = (np.concatenate([a, b]) for a, b in zip((self.c, self.t, self.ins), u))

    def lead(self) -> None:
        """What was fed so far belongs to pieces of the block before: only its end is kept, as the overlap."""
        self.fresh = len(self.c)
        if self.fresh:
            cc, ct = np.r_[0, np.cumsum(self.c)], np.r_[0, np.cumsum(self.t)]
            self._drop(self._next(self.fresh, 0, cc, ct), cc)

    def _drop(self, k: int, cc: np.ndarray) -> None:
        if k:
            self.inside = bool(self.ins[k - 1])
        self.text, self.at = self.text[int(cc[k]) :], self.at + int(cc[k])
        self.c, self.t, self.ins, self.fresh = self.c[k:], self.t[k:], self.ins[k:], self.fresh - k

    def _next(self, cut: int, lo: int, cc: np.ndarray, ct: np.ndarray) -> int:
        """The unit where the piece after `cut` begins: a word start in the first half of the overlap, else exactly that far back."""
        if not self.overlap:
            return cut
        back = max(int(np.searchsorted(ct, ct[cut] - self.overlap, "left")), lo)
        half = int(np.searchsorted(ct, ct[cut] - self.overlap / 2, "right")) - 1
        a, b = int(cc[back]), int(cc[max(half, back)])
        for j in (self.text.find("\n", max(a - 1, 0), b), self.text.find(" ", a, b)):
            if j >= 0:
                k = int(np.searchsorted(cc, j + (self.text[j] == "\n"), "left"))
                if back <= k <= max(half, back):
                    return k
        return back

    def _best(self, lo: int, soft: int, hi: int, cc: np.ndarray) -> tuple[int, int]:
        """(unit, level) of the last best cut among the ends of units soft..hi."""
        a, b, text = int(cc[soft]), int(cc[hi]), self.text
        end = lambda j: int(np.searchsorted(cc, j, "right")) - 1  # noqa: E731  (the last unit end at or before j)
        for level, marks in ((4, ("\n\n",)), (3, ("\n",))):
            to = b
            while (j := max(text.rfind(m, max(a - 2, 0), to) for m in marks)) >= 0:
                k = j + level - 2
                while k < b and text[k].isspace():
                    k += 1
                if k < len(text) and text[k - 1] == " ":
                    k -= 1
                k = end(min(k, b))
                if k < soft:
                    break
                if int(cc[k]) > j:
                    return k, level
                to = j
        to = b
        while (j := max(max(text.rfind(m + s, max(a - 1, 0), to + 1) for m in ".!?…:;" for s in " \n\t"), max(text.rfind(m, max(a - 1, 0), to) for m in "。！？；"))) >= 0:
            if (k := end(j + 1)) >= soft and int(cc[k]) == j + 1:
                return k, 2
            to = j
        j = max(text.rfind(s, a, b + 1) for s in (" ", "\t", "　"))
        if j >= 0 and (k := end(j)) >= soft and int(cc[k]) == j:
            return k, 1
        return hi, 0

    def _size(self, lo: int, cut: int, cc: np.ndarray, ct: np.ndarray) -> int:
        """Tokens of the piece as a text of its own: it may begin or end inside a piece of the tokenizer, and blanks at its end stand together."""
        x = self.text[int(cc[lo]) : int(cc[cut])]
        if (self.ins[lo - 1] if lo else self.inside) or self.ins[cut - 1] or (self.ins[lo:cut] == 2).any():
            return self.size.count(x)
        if x and x[-1].isspace():
            j = int(np.searchsorted(cc, cc[lo] + len(x.rstrip()), "right")) - 1
            return int(ct[max(j, lo)] - ct[lo]) + self.size.count(self.text[int(cc[max(j, lo)]) : int(cc[cut])])
        return int(ct[cut] - ct[lo])

    def pieces(self, last: bool) -> Iterator[tuple[int, int, int, str, str]]:
        """(start, end, tokens, kind of cut, text) of the pieces that are complete; of all with `last`."""
        cc, ct = np.r_[0, np.cumsum(self.c)], np.r_[0, np.cumsum(self.t)]
        lo, n = 0, len(self.t)
        while self.fresh < n:
            hi = int(np.searchsorted(ct, ct[lo] + self.most, "right")) - 1
            if hi >= n and not last:
                break
            while hi <= self.fresh:  # the overlap leaves no room for the next unit
                if lo == self.fresh:
                    hi = lo + 1
                    break
                lo += 1
                hi = int(np.searchsorted(ct, ct[lo] + self.most, "right")) - 1
            while True:
                if hi >= n:
                    cut, level = n, 5
                else:
                    soft = max(self.fresh + 1, int(np.searchsorted(ct, ct[lo] + self.most // 2)))
                    cut, level = self._best(lo, min(soft, hi), hi, cc)
                size = self._size(lo, cut, cc, ct)
                if size <= self.most or cut - lo <= 1:
                    break
                # Tokens inside a run needn't add up: fewer units, or a shorter overlap.
                if cut - 1 > self.fresh:
                    hi = max(self.fresh + 1, cut - max(1, size - self.most))
                else:
                    lo += 1
            yield self.at + int(cc[lo]), self.at + int(cc[cut]), size, self.end if level == 5 else CUTS[level], self.text[int(cc[lo]) : int(cc[cut])]
            self.fresh = cut
            if cut == n and last:
                break
            lo = max(self._next(cut, lo, cc, ct), lo + 1 if cut > lo + 1 else lo)
            lo = min(lo, cut)
        self._drop(lo, cc)


def _rows(rows: list[tuple], schema: str = PIECE) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], [n for n, _ in names])


def _whole(path: str):
    """Texts of one range: counted, and cut if they are oversized, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(path)
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):
                doc, most, overlap, text = (b.column(k)[i].as_py() for k in range(4))
                if sum(map(size.__getitem__, size.pieces(text))) <= most:
                    continue
                p = Packer(most, overlap, size)
                p.feed(text, units(text, "", size, most))
                out += [(doc, k, *x) for k, x in enumerate(p.pieces(True))]
                held += len(text)
                if held > 4_000_000:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return run


_RANGE = "uid long, doc_id long, most int, overlap int, k long, size long, own int, head int, last boolean, part string"


def _char_start(raw, i: int) -> int:
    while i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    return i


def _range_row(ids: tuple, k: int, n: int, raw, base: int, width: int, halo: int) -> tuple:
    """The k-th range of a text of n bytes, of which raw are those from `base` on: whole characters, and the halo behind them."""
    at = lambda i: base + _char_start(raw, min(i, n) - base)
    lo, hi = (at(k * width) if k else 0), at((k + 1) * width)
    head, to = at(k * width + halo), at((k + 1) * width + halo)
    text = lambda a, b: bytes(raw[a - base : b - base]).decode("utf-8", "replace")
    part = text(lo, to)
    return (*ids, k, n, len(text(lo, hi)), len(text(lo, head)), hi >= n, part)


def _cut_ranges(width: int, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = tuple(b.column(k)[i].as_py() for k in range(4))
                raw = np.frombuffer(b.column(4)[i].as_buffer(), np.uint8)
                out = []
                for k in range(-(-len(raw) // width)):
                    out.append(_range_row(ids, k, len(raw), raw, 0, width, halo))
                    if len(out) == 64:
                        yield _rows(out, _RANGE)
                        out = []
                if out:
                    yield _rows(out, _RANGE)

    return run


def _read_ranges(width: int, halo: int):
    """Reads one byte range of a file each, and nothing else of it. Rows: (uid, doc_id, most, overlap, k, length, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for i in range(b.num_rows):
                *ids, k, n, path = (b.column(j)[i].as_py() for j in range(7))
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_file(at) as f:
                    raw = np.frombuffer(f.read_at(min(n - k * width, width + halo + 8), k * width), np.uint8)
                yield _rows([_range_row(tuple(ids), k, n, raw, k * width, width, halo)], _RANGE)

    return run


def _stretch(k: int, own: int, head: int, last: bool, part: str) -> tuple[str, str, bool, str]:
    """(text, what follows it, whether its end lies inside a run, kind of its end): the part of a range with its halo that is its own, by the same rule on both sides of a border."""
    a = natural_start(part[:head])[0] if k else 0
    e, le = (len(part), 0) if last else natural_start(part[own:])
    e = e if last else own + e
    return part[a:e], part[e:] if le >= 0 else "", le < 0, "end" if last else CUTS[max(le, 0)]


def _measured(path: str):
    """The boundary table: characters and tokens of the stretch of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(path)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                uid, doc, most, overlap, k, n, own, head, last, part = (b.column(j)[i].as_py() for j in range(10))
                text, after, hard, _ = _stretch(k, own, head, last, part)
                out.append((uid, k, len(text), int(units(text, after, size, most)[1].sum()), hard))
            yield _rows(out, "uid long, k long, chars long, toks long, hard boolean")

    return run


def _packed(path: str):
    """Rows sorted by (uid, block, k): ranges of one block in order, those of the block before (lead) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, now, p, no = sizes(path), None, None, 0
        doc = maybe = most = None
        leading, held = False, []

        def done(out: list, last: bool) -> None:
            nonlocal no
            if p is None or leading:
                return
            if maybe:  # undecided: at most size.longest x limit bytes, counted as a whole
                if not last:
                    return
                if size.count("".join(held)) <= most:
                    return
            for x in p.pieces(last):
                out.append((doc, no, *x, *now))
                no += 1

        schema = PIECE + ", uid long, block long"
        for b in batches:
            out, chars = [], 0
            for i in range(b.num_rows):
                uid, block, doc_, most_, overlap, k, own, head, last, part, at, lead, maybe_ = (b.column(j)[i].as_py() for j in range(13))
                if (uid, block) != now:
                    done(out, True)
                    now, doc, most, maybe, no, held = (uid, block), doc_, most_, maybe_, 0, []
                    p, leading = Packer(most, overlap, size, at), False
                text, after, hard, p.end = _stretch(k, own, head, last, part)
                if leading and not lead:
                    p.lead()
                leading = lead
                p.feed(text, units(text, after, size, most), hard)
                if maybe:
                    held.append(text)
                done(out, False)
                chars += len(part)
                if chars > 4_000_000:
                    yield _rows(out, schema)
                    out, chars = [], 0
            if out:
                yield _rows(out, schema)
        out = []
        done(out, True)
        yield _rows(out, schema)

    return run


def _of_ranges(ranges: DataFrame, path: str, block: int = 32) -> DataFrame:
    """Pieces of the texts whose ranges these are.

    The stretches of all ranges are measured, one per row; prefix sums over each text's table (one short row a range) give
    the place and the token count before each. Texts within their limit end here. Every `block` limits' worth of tokens
    begins a block at a range's start, a natural boundary; blocks are packed in parallel, from the ranges' texts.
    """
    r = stage(ranges.repartition("uid", "k"))
    m = stage(r.mapInArrow(_measured(path), "uid long, k long, chars long, toks long, hard boolean"))
    w = Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("uid")
    t = m.withColumn("at", F.coalesce(F.sum("chars").over(w), F.lit(0))).withColumn("before", F.coalesce(F.sum("toks").over(w), F.lit(0)))
    t = t.withColumn("total", F.sum("toks").over(every)).withColumn("any_hard", F.max("hard").over(every))
    longest = sizes(path).longest
    t = t.join(r.select("uid", "k", "most", "overlap", "size"), ["uid", "k"])
    # Counts are exact unless a run goes through a border; then the longest token bounds them, or the text is counted as a whole.
    sure = F.when(F.col("any_hard"), F.col("size") > longest * F.col("most").cast("long")).otherwise(F.col("total") > F.col("most"))
    t = t.withColumn("maybe", F.col("any_hard") & ~sure).filter(sure | F.col("maybe"))
    t = t.withColumn("block", F.when(F.col("maybe"), F.lit(0).cast("long")).otherwise(F.floor(F.col("before") / (block * F.col("most"))).cast("long")))
    t = stage(t.select("uid", "k", "most", "overlap", "at", "before", "toks", "maybe", "block"))
    # Ranges that reach into the overlap before the next block's first piece lead that block.
    begin = t.groupBy("uid", "block").agg(F.min("before").alias("begin"))
    nxt = begin.withColumn("to", F.lead("block").over(Window.partitionBy("uid").orderBy("block"))).withColumn("begin", F.lead("begin").over(Window.partitionBy("uid").orderBy("block"))).filter("to is not null")
    lead = t.join(nxt, ["uid", "block"]).filter((F.col("overlap") > 0) & (F.col("before") + F.col("toks") > F.col("begin") - F.col("overlap"))).select("uid", "k", "at", F.col("to").alias("block"), "maybe", F.lit(True).alias("lead"))
    rows = t.select("uid", "k", "at", "block", "maybe", F.lit(False).alias("lead")).union(lead)
    x = r.join(rows, ["uid", "k"]).select("uid", "block", "doc_id", "most", "overlap", "k", "own", "head", "last", "part", "at", "lead", "maybe")
    got = stage(x.repartition("uid", "block").sortWithinPartitions("uid", "block", "k").mapInArrow(_packed(path), PIECE + ", uid long, block long"))
    n = got.groupBy("uid", "block").agg(F.count("*").alias("n"))
    first = n.select("uid", "block", F.coalesce(F.sum("n").over(Window.partitionBy("uid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return got.join(first, ["uid", "block"]).select("doc_id", (F.col("piece_no") + F.col("first")).alias("piece_no"), "start", "end", "n_tokens", "cut", "text")


def _limits(plan: DataFrame) -> DataFrame:
    """(source, most, overlap): one row a source; refuses limits that can't hold a character."""
    low = plan.filter(F.col("max_tokens") < LEAST).limit(1).collect()
    if low:
        raise ValueError(f"a limit of {low[0]['max_tokens']} tokens can't hold every character, which takes up to {LEAST}")
    p = plan.filter("max_tokens is not null").groupBy("source").agg(F.min(F.struct(F.col("max_tokens").cast("int").alias("most"), F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)).cast("int").alias("overlap"))).alias("p"))
    return p.select("source", "p.*")


def pieces(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = DEFAULT, width: int = RANGE, halo: int = HALO, block: int = 32) -> DataFrame:
    """(doc_id, piece_no, start, end, n_tokens, cut, text): the pieces of every text of more tokens than its source's limit.

    Pieces follow each other, cover the text, and hold at most max_tokens tokens each, counted on the piece itself; start and
    end are character offsets. A piece ends at the best cut in the second half of what fits: paragraph, line, sentence,
    word, else inside a word. The next piece begins up to overlap_tokens before the end of the last (as near to it as a word
    start allows; an overlap of over half the limit counts as half). Texts within the limit, null texts, null ids and
    texts of sources without a plan aren't cut; a row that occurs twice is cut twice. A limit below 4 tokens is an error.

    A text of at most `width` bytes is counted and cut where it is read. A larger one is taken apart into byte ranges of that
    size, each with a halo of the next bytes; from then on no row holds more (see _of_ranges). Range and halo agree on the
    first natural boundary of the halo as the border; where a run without any goes through, the border lies inside it.
    """
    ship_vocabulary(docs.sparkSession, path)
    halo = min(halo, width // 2)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("doc_id is not null")
    d = d.join(F.broadcast(_limits(plan)), "source").filter(F.octet_length("text") > F.col("most")).select("doc_id", "most", "overlap", "text")
    small = d.filter(F.octet_length("text") <= width).mapInArrow(_whole(path), PIECE)
    giant = d.filter(F.octet_length("text") > width).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "most", "overlap", "text")
    return small.union(_of_ranges(giant.mapInArrow(_cut_ranges(width, halo), _RANGE), path, block))


def file_pieces(spark: SparkSession, files: str, most: int, overlap: int = 0, path: str = DEFAULT, width: int = RANGE, halo: int = HALO, block: int = 32) -> DataFrame:
    """As pieces, for UTF-8 text files (a path or glob): (path, piece_no, start, end, n_tokens, cut, text).

    Files are listed without their content; each task reads the byte ranges it was given and no others.
    """
    if most < LEAST:
        raise ValueError(f"a limit below {LEAST} tokens can't hold every character")
    ship_vocabulary(spark, path)
    halo = min(halo, width // 2)
    f = stage(spark.read.format("binaryFile").load(files).select("path", F.col("length").cast("long").alias("size")).filter(F.col("size") > most).withColumn("id", F.monotonically_increasing_id()))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width).cast("long")))
    r = f.select(F.col("id").alias("uid"), F.col("id").alias("doc_id"), F.lit(most).alias("most"), F.lit(overlap).alias("overlap"), k.alias("k"), "size", "path").repartition("uid", "k")
    got = _of_ranges(r.mapInArrow(_read_ranges(width, halo), _RANGE), path, block)
    return got.join(f.select(F.col("id").alias("doc_id"), "path"), "doc_id").select("path", "piece_no", "start", "end", "n_tokens", "cut", "text")
