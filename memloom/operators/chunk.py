"""Documents to chunks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions import tables
from memloom.operators.merge import once

WORDS = r"\s+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, WORDS), "")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Arrays of tokens, `size` long, each starting size - overlap after the one before."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))


class Tokenizer(NamedTuple):
    """How texts are cut into tokens, and what stands between tokens that are put together again."""

    split: Callable[[Column], Column] = _tokens
    glue: str = " "


PLAIN = Tokenizer()


def chunk_fixed(docs: DataFrame, size: int = 1200, overlap: int = 100, tokenizer: Tokenizer = PLAIN) -> DataFrame:
    """C1. (doc_id, chunk_order_index, content, tokens)."""
    rows = docs.select("doc_id", tokenizer.split(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.posexplode(windows(F.col("t"), size, overlap)).alias("chunk_order_index", "w"))
    return rows.select("doc_id", "chunk_order_index", F.array_join("w", tokenizer.glue).alias("content"), F.size("w").cast("long").alias("tokens"))


def chunk_by_delimiter(docs: DataFrame, delimiter: str, size: int = 1200, overlap: int = 100, only: bool = False, tokenizer: Tokenizer = PLAIN) -> tuple[DataFrame, DataFrame]:
    """C2. (chunks, errors): pieces between delimiters; a piece above size is windowed, or, if only, an error."""
    escaped = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiter)
    rows = docs.select("doc_id", F.posexplode(F.split("text", escaped)).alias("piece", "p")).filter(F.trim("p") != "").withColumn("t", tokenizer.split(F.col("p")))
    if only:
        good = rows.filter(F.size("t") <= size).select("doc_id", "piece", F.lit(0).alias("part"), F.col("t").alias("w"))
    else:
        good = rows.select("doc_id", "piece", F.posexplode(windows(F.col("t"), size, overlap)).alias("part", "w"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("piece", "part")) - 1
    out = good.select("doc_id", order.alias("chunk_order_index"), F.array_join("w", tokenizer.glue).alias("content"), F.size("w").cast("long").alias("tokens"))
    errors = rows.filter(F.size("t") > size).select("doc_id", "piece", F.size("t").cast("long").alias("tokens"))
    return out, errors if only else errors.limit(0)


def chunk_recursive(docs: DataFrame, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> DataFrame:
    """C3. Split at the first separator that a text holds, go on inside what is too long, and pack neighbours up to size
    characters; what has no separator is cut every size - overlap. Null and blank texts have no chunks."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def split(text: str, seps: tuple[str, ...]) -> list[str]:
        if len(text) <= size:
            return [text]
        at = next((i for i, s in enumerate(seps) if s and s in text), None)
        if at is None:
            return [text[i : i + size] for i in range(0, len(text), size - overlap)]
        parts = text.split(seps[at])
        parts = [p + seps[at] for p in parts[:-1]] + parts[-1:]
        out, held = [], ""
        for p in (q for part in parts for q in split(part, seps[at + 1 :])):
            if held and len(held) + len(p) > size:
                out.append(held)
                held = held[-overlap:] if overlap and len(p) + overlap <= size else ""
            held += p
        return [*out, held] if held else out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(r.doc_id, i, c.strip()) for r in pdf.itertuples() for i, c in enumerate(x for x in split(r.text or "", separators) if x.strip())]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_order_index", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_order_index int, content string")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)."""
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))


def chunk_semantic(rows: DataFrame, distance: str = "distance", kind: str = "percentile", amount: float = 0.95, least: int = 0) -> DataFrame:
    """C4. Groups of sentences, broken where the distance to the next one is above the document's limit, unless the group would
    have fewer than `least` characters. kind: percentile (amount: the share below the limit), standard_deviation and
    interquartile (mean, plus amount times the deviation, or the range between the quartiles), gradient (percentile of the
    distances' gradients). rows: (doc_id, pos, sentence, distance to the next sentence). A group beyond a size is for `chunk_recursive`."""
    own = W.partitionBy("doc_id").orderBy("pos")
    value = F.col(distance)
    if kind == "gradient":  # central differences, one-sided at both ends
        after, before = F.lead(value).over(own), F.lag(value).over(own)
        rows = rows.withColumn("_v", F.when(value.isNotNull(), F.coalesce((after - before) / 2, after - value, value - before)))
    elif kind in ("percentile", "standard_deviation", "interquartile"):
        rows = rows.withColumn("_v", value)
    else:
        raise ValueError("kind must be percentile, standard_deviation, interquartile or gradient")
    limit = {
        "percentile": lambda: F.percentile("_v", amount),
        "gradient": lambda: F.percentile("_v", amount),
        "standard_deviation": lambda: F.avg("_v") + amount * F.stddev_pop("_v"),
        "interquartile": lambda: F.avg("_v") + amount * (F.percentile("_v", 0.75) - F.percentile("_v", 0.25)),
    }[kind]()
    met = rows.join(rows.groupBy("doc_id").agg(limit.alias("limit")), "doc_id").select("doc_id", "pos", "sentence", F.coalesce(F.col("_v") > F.col("limit"), F.lit(False)).alias("b"))
    # a fold over the document's sentences: a break counts only where the group is long enough
    step = lambda acc, x: F.struct(
        F.when(x["b"] & (acc["n"] + F.length(x["sentence"]) >= least), 0).otherwise(acc["n"] + F.length(x["sentence"]) + 1).alias("n"),
        F.when(x["b"] & (acc["n"] + F.length(x["sentence"]) >= least), acc["g"] + 1).otherwise(acc["g"]).alias("g"),
        F.array_append(acc["at"], acc["g"]).alias("at"),
    )
    per = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "b"))).alias("s"))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("at"))
    placed = per.select("doc_id", "s", F.aggregate("s", state, step, lambda a: a["at"]).alias("at"))
    each = placed.select("doc_id", F.posexplode(F.arrays_zip(F.col("s.sentence").alias("sentence"), F.col("at").alias("g"))).alias("i", "x")).select("doc_id", "i", "x.sentence", F.col("x.g").alias("chunk_order_index"))
    return each.groupBy("doc_id", "chunk_order_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("content"))


def to_blocks(docs: DataFrame) -> DataFrame:
    """C12. Markdown texts as blocks (doc_id, block, level, heading, content): a block for each heading's own text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    level = F.length(F.regexp_extract("l", r"^(#{1,6})\s", 1))
    lines = lines.withColumn("level", level).withColumn("block", F.sum((level > 0).cast("int")).over(W.partitionBy("doc_id").orderBy("line")))
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "l"))))
    out = lines.groupBy("doc_id", "block").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("l", r"^#+\s+", "")))).alias("heading"), body.alias("b"))
    return out.select("doc_id", "block", "level", F.coalesce("heading", F.lit("")).alias("heading"), F.regexp_replace(F.array_join(F.transform("b", lambda x: x["l"]), "\n"), r"^\s+|\s+$", "").alias("content"))


ARROW, MORE = " → ", "…"


def clean_heading(text: Column, chars: int) -> Column:
    """A heading on one line: no arrows and invisible characters, white space runs as one space; beyond `chars` cut, with a mark."""
    out = F.regexp_replace(F.replace(text, F.lit("→"), F.lit(" ")), r"(?U)[\p{Cc}\p{Cf}&&[^\s]]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(out) > chars, F.concat(F.rtrim(F.substring(out, 1, chars - 1)), F.lit(MORE))).otherwise(out)


def within_budget(levels: Column, budget: int) -> Column:
    """Levels joined by arrows; beyond `budget` tokens the first and last one only, and beyond that the first tokens, with a mark."""
    whole = F.array_join(levels, ARROW)
    short = F.when(F.size(levels) >= 3, F.concat_ws(ARROW, levels[0], F.lit(MORE), F.element_at(levels, -1))).otherwise(whole)
    n = lambda c: F.size(_tokens(c))
    first = F.concat(F.array_join(F.slice(_tokens(short), 1, max(budget - 1, 0)), " "), F.lit(MORE))
    return F.when(n(whole) <= budget, whole).when(n(short) <= budget, short).otherwise(first)


def heading_paths(blocks: DataFrame, chars: int = 80, budget: int | None = None) -> DataFrame:
    """C9. blocks with path: cleaned headings of the levels above and their own, joined by arrows, each of at most `chars`
    characters, all of at most `budget` tokens."""
    own = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    out = blocks
    for n in range(1, 7):  # a heading stands until one of its level or above
        above = F.last(F.when(F.col("level").between(1, n), F.struct("level", "heading")), ignorenulls=True).over(own)
        out = out.withColumn(f"_h{n}", F.when(above["level"] == n, clean_heading(above["heading"], chars)))
    keep = F.filter(F.array(*(F.when(F.lit(n) <= F.col("level"), F.col(f"_h{n}")) for n in range(1, 7))), lambda x: x.isNotNull() & (x != ""))
    path = F.array_join(keep, ARROW) if budget is None else within_budget(keep, budget)
    return out.withColumn("path", path).drop(*(f"_h{n}" for n in range(1, 7)))


def enforce_token_limit(chunks: DataFrame, most: int, tokenizer: Tokenizer = PLAIN) -> DataFrame:
    """C7. Chunks above most tokens as parts: whole sentences packed greedily, longer sentences windowed; ids get -sNN.
    tokenizer says what a token is; sentences stand apart by a space. Texts and sentences are cut into tokens once; where tokens are
    words (PLAIN), those of joined pieces add up."""
    n = lambda c: F.size(tokenizer.split(c))
    rows = chunks.select("doc_id", "chunk_id", "chunk_order_index", "content", once(n=n(F.col("content"))))
    long = F.when(F.col("n") > most, F.split("content", r"(?<=[.!?])\s+"))
    cut = F.transform(F.transform(long, lambda s: tokenizer.split(s)), lambda t: windows(t, most, 0))
    pieces = F.flatten(F.transform(cut, lambda ws: F.transform(ws, lambda w: F.struct(F.array_join(w, tokenizer.glue).alias("s"), F.size(w).alias("n")))))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    size = (lambda text, counted: counted) if tokenizer is PLAIN else (lambda text, counted: n(text))

    def step(acc: Column, x: Column) -> Column:
        own, held = size(x["s"], x["n"]), size(acc["cur"], acc["n"])
        fits = held + own <= most
        joined = F.trim(F.concat(acc["cur"], F.lit(" "), x["s"]))
        return F.struct(F.when(fits, acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])).alias("out"), F.when(fits, joined).otherwise(x["s"]).alias("cur"), F.when(fits, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"))

    packed = F.aggregate(pieces, state, step, lambda a: F.array_append(a["out"], a["cur"]))
    parts = F.when(F.col("n") <= most, F.array("content")).otherwise(packed)
    rows = rows.select("doc_id", "chunk_id", "chunk_order_index", F.posexplode(parts).alias("part", "content"), F.coalesce(F.col("n") > most, F.lit(False)).alias("split"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_order_index", "part")) - 1
    return rows.select("doc_id", F.when(F.col("split"), F.format_string("%s-s%02d", F.col("chunk_id").cast("string"), F.col("part") + 1)).otherwise(F.col("chunk_id")).alias("chunk_id"), order.alias("chunk_order_index"), "content")


#: Characters of a bin, by which spans meet.
BIN = 2048


def overlaps(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN) -> DataFrame:
    """Rows of left and right of one key whose half-open spans overlap, each pair once; right's columns must have other names than left's,
    but for the key. Spans are cut into bins of `width` and meet by (key, bin), so what does not lie near is never paired; a
    pair counts in its first common bin."""

    def binned(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        low, high = (F.floor(F.col(c) / width) for c in (span[0], "_last"))
        df = df.withColumn("_last", F.greatest(F.col(span[0]), F.col(span[1]) - 1)).withColumn(first, low)
        return df.withColumn("_bin", F.explode(F.sequence(F.col(first), high))).drop("_last")

    met = binned(left, left_span, "_f1").join(binned(right, right_span, "_f2"), [key, "_bin"]).filter(F.col("_bin") == F.greatest("_f1", "_f2"))
    met = met.filter((F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1])))
    return met.drop("_bin", "_f1", "_f2")


def attribute_blocks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """C8. (doc_id, chunk_id, block_id, refs): blocks whose span overlaps the chunk's, in order. chunks: (doc_id, chunk_id, start, end);
    blocks: (doc_id, block, content), joined by single line feeds. An interval join: spans meet by bins."""
    own = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    spans = blocks.withColumn("b0", F.coalesce(F.sum(F.length("content") + 1).over(own), F.lit(0))).withColumn("b1", F.col("b0") + F.length("content"))
    met = overlaps(chunks.select("doc_id", "chunk_id", "start", "end"), spans.select("doc_id", "block", "b0", "b1"), "doc_id", ("start", "end"), ("b0", "b1"))
    return met.groupBy("doc_id", "chunk_id").agg(F.min("block").alias("block_id"), F.array_sort(F.collect_set("block")).alias("refs"))


#: Headings that begin a list of references. Fixed values.
REFERENCES = ("references", "bibliography", "参考文献")
#: Shares of the largest size: wanted, and below which a chunk is small; characters of a line that may begin a part. Fixed values.
IDEAL, SMALL, ANCHOR = 0.75, 0.125, 100


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value): inside a function of arrays, value is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_tables(blocks: DataFrame, most: int) -> DataFrame:
    """C6. blocks (doc_id, block, ..., content) with tables of more than `most` tokens split between rows: (…, part, content). The
    slices have nearly equal numbers of rows, each with the table's header rows; text around a table is a part of its own. Inner tables
    stay inside their row, JSON lists of rows are split like rows."""
    piece = F.filter(F.split(F.regexp_replace("content", r"(?is)(<table\b.*?</table>)", "\u0000$1\u0000"), "\u0000"), lambda x: F.trim(x) != "")

    header = lambda r: r.rlike("(?i)<th")

    def slices(t: Column) -> Column:
        def made(n: Column) -> Column:
            rows = F.regexp_extract_all(t, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
            parts = held(rows, lambda r: F.struct(F.array_join(F.filter(r, header), "").alias("head"), F.filter(r, lambda x: ~header(x)).alias("body")))
            need = F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
            return held(parts, lambda x: F.when(F.size(x["body"]) > 1, cut(x, F.greatest(F.ceil(F.size(x["body"]) / need), F.lit(1)).cast("int"))).otherwise(F.array(t)))

        def cut(x: Column, per: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(x["body"]) - 1, per)
            return held(per, lambda p: F.transform(starts, lambda i: F.concat(F.lit("<table>"), x["head"], F.array_join(F.slice(x["body"], i + 1, p), ""), F.lit("</table>"))))

        return F.when(t.rlike("(?i)^<table"), held(F.size(_tokens(t)), lambda n: F.when(n > most, made(n)).otherwise(F.array(t)))).otherwise(F.array(t))

    rest = [c for c in blocks.columns if c != "content"]
    # tables in tables, unequal numbers of row tags and JSON bodies are for a scanner of tags; all other blocks stay in the JVM
    count = lambda p: F.regexp_count("content", F.lit(p))
    odd = (count(r"(?i)<table\b") != count(r"(?is)<table\b.*?</table")) | F.col("content").rlike(r"(?i)<table\b[^>]*>\s*\[") | (count(r"(?i)<tr\b") != count(r"(?i)</tr\b"))
    odd = F.coalesce(odd, F.lit(False))

    @F.pandas_udf("array<string>")
    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tables.split(t, most))

    # in one pass: the scanner gets nothing of the other blocks
    rows = blocks.select(*rest, "content", once(_odd=odd)).withColumn("_scanned", scanned(F.when(F.col("_odd"), F.col("content"))))
    parts = F.when(F.col("_odd"), F.col("_scanned")).otherwise(F.flatten(F.transform(piece, slices)))
    return rows.select(*rest, F.posexplode(parts).alias("part", "content"))


def drop_reference_blocks(blocks: DataFrame, last: int = 0) -> DataFrame:
    """C5. blocks without those headed as references, among the last `last` ones of a document (0: all); a document that
    would have no content left keeps them."""
    own = W.partitionBy("doc_id")
    place = F.row_number().over(own.orderBy(F.desc("block")))
    # after ASCII letters the word must end; other scripts do not mark where a word ends
    named = "|".join(w + r"(?![\p{L}\p{N}])" if w.isascii() else w for w in REFERENCES)
    hit = F.lower(F.trim("heading")).rlike(f"^({named})") & ((place <= last) if last else F.lit(True))
    rows = blocks.withColumn("_r", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_left", F.max(~F.col("_r") & (F.trim("content") != "")).over(own))
    return rows.filter(~F.col("_r") | ~F.col("_left")).drop("_r", "_left")


def chunk_blocks(blocks: DataFrame, size: int = 2000, drop_references: bool = False) -> DataFrame:
    """C5. (doc_id, chunk_order_index, heading, level, content, tokens, blocks) from heading blocks (doc_id, block, level, heading,
    content). Tables beyond half of `size` are split by rows (C6); a block above `size` tokens is cut at its short lines (anchors), those nearest
    to where equal parts of IDEAL of it would end, and again as long as a part is above size; a part is headed by the line that
    begins it, under the block's heading. Without short lines it is cut between its lines, packed up to IDEAL (a longer line by C7's
    windows). Its parts are named [part n]; a heading without text goes before what
    follows; then small neighbours under one heading merge, deepest level first, as long as they stay within IDEAL. Documents are
    independent; one document's blocks are one group."""
    rows = drop_reference_blocks(blocks) if drop_references else blocks
    rows = split_tables(rows.select("doc_id", "block", "level", "heading", "content").withColumn("content", F.when(F.trim("content") == "", " \u2060").otherwise(F.col("content"))), max(size // 2, 1))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    ideal, small = max(int(size * IDEAL), 1), max(int(size * SMALL), 1)

    def packed(text: str) -> list[str]:
        """Lines packed up to the ideal size; longer lines in windows."""
        out, held, n = [], [], 0
        for line in text.split("\n"):
            words = line.split()
            for part in [" ".join(words[i : i + size]) for i in range(0, len(words), size)] if len(words) > size else [line]:
                m = len(part.split())
                if held and n + m > ideal:
                    out.append("\n".join(held))
                    held, n = [], 0
                held.append(part)
                n += m
        return [*out, "\n".join(held)] if held else out

    def anchored(text: str, begins: str = "") -> list[tuple[str, str]]:
        """(anchor, part) of a text above the size; the anchor is the line that begins the part, nothing for the first one."""
        lines, at, anchors = text.split("\n"), 0, []
        for i, line in enumerate(lines):
            if i and 0 < len(line) <= ANCHOR:
                anchors.append((at, i))
            at += len(line.split())
        if not anchors:
            return [(begins, p) for p in packed(text)]
        n, chosen = max(math.ceil(at / ideal), math.ceil(at / size)), []
        for k in range(1, n):
            if anchors:
                best = min(anchors, key=lambda a: abs(a[0] - k * at / n))  # noqa: B023
                anchors.remove(best)
                chosen.append(best[1])
        cuts = [0, *sorted(chosen), len(lines)]
        out = []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part, name = "\n".join(lines[i:j]), lines[i].strip() if k else begins
            out += [(name, part)] if len(part.split()) <= size else anchored(part, name)
        return out

    def chunks_of(parts: list[dict]) -> list[dict]:
        """The chunks of a document's parts, in order."""
        found, waiting = [], []
        for block, same in groupby(parts, key=lambda x: x["block"]):
            group = list(same)
            level, heading = int(group[0]["level"]), group[0]["heading"] or ""
            texts = [x["content"].replace("\u2060", "").strip() for x in group]
            parts = [p for t in texts if t for p in ([("", t)] if t.lower().startswith("<table") or len(t.split()) <= size else anchored(t))]
            if not parts:  # a heading alone: it goes before the next block
                waiting.append((level, heading))
                continue
            before = [h for lv, h in waiting if lv < level and h]
            waiting = []
            for i, (anchor, p) in enumerate(parts, 1):
                name = " → ".join(x for x in (heading, anchor) if x)
                name = f"{name} [part {i}]" if len(parts) > 1 else name
                found.append({"level": level, "heading": " → ".join([*before, name]), "content": p, "n": len(p.split()), "blocks": [int(block)], "whole": len(parts) == 1})
        for _, heading in waiting:
            if heading:
                found.append({"level": 1, "heading": heading, "content": heading, "n": len(heading.split()), "blocks": [], "whole": True})
        for level in sorted({x["level"] for x in found}, reverse=True):
            merged = []
            for x in found:
                last = merged[-1] if merged else None
                if last and x["whole"] and last["whole"] and x["level"] == level and last["level"] >= level - 1 and min(x["n"], last["n"]) <= max(small, ideal // 2) and last["n"] + x["n"] <= ideal:
                    last["content"] += "\n" + x["content"]
                    last["n"] += x["n"]
                    last["blocks"] = [*last["blocks"], *x["blocks"]]
                    last["level"] = min(last["level"], x["level"])
                else:
                    merged.append(dict(x))
            found = merged
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, parts in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = chunks_of(parts)
                if found:
                    columns = [[x[c] for x in found] for c in ("heading", "level", "content", "n", "blocks")]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(found), doc.type), pa.array(range(len(found)), pa.int32()), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()))
    names = ["doc_id", "chunk_order_index", "heading", "level", "content", "tokens", "blocks"]
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "part", "level", "heading", "content"))).alias("parts"))
    return per.mapInArrow(run, f"doc_id {kind}, chunk_order_index int, heading string, level int, content string, tokens long, blocks array<int>")


def surrounding(items: DataFrame, blocks: DataFrame, leading: int, trailing: int) -> DataFrame:
    """C11. (doc_id, item_id, leading, trailing): the nearest tokens before and after an item's mark in its block, at most so many;
    empty if the block does not hold the mark. Other tags are left out of the text; rows of a table stand as their cells.
    items: (doc_id, block, item_id, mark); blocks: (doc_id, block, content)."""
    met = items.join(blocks.select("doc_id", "block", "content"), ["doc_id", "block"], "left").withColumn("_at", F.coalesce(F.expr("locate(mark, content)"), F.lit(0)))
    plain = lambda c: _tokens(F.regexp_replace(c, r"<[^>]*>", " "))
    before = plain(F.expr("substring(content, 1, greatest(_at - 1, 0))"))
    after = plain(F.expr("substring(content, _at + length(mark))"))
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))
    inside = F.col("_at") > 0
    lead = F.when(inside, F.array_join(last(before, leading), " ")).otherwise("")
    trail = F.when(inside, F.array_join(F.slice(after, 1, trailing), " ")).otherwise("")
    return met.select("doc_id", "item_id", lead.alias("leading"), trail.alias("trailing"))
