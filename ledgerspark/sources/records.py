"""CSV records of files of any size and width.

A file is read as lines, in as many tasks as it has blocks. Whether a line begins inside quotes depends on
all lines before it, so it is found in two steps: every block tells where it would end inside or outside
quotes for both ways of beginning, and a window over one row per block puts these together. Then each block
is parsed on its own; a record that reaches over the end of its block is put together from its pieces.

Quotes, line breaks and commas are the same single bytes in both encodings, so lines are cut before they
are decoded.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.session import BROADCAST_BYTES, settle, store

UTF8, GB18030 = "UTF-8", "GB18030"
BOM = b"\xef\xbb\xbf"
BLOCK_KEY = ["source_file", "block"]
# Kinds of rows that parsing gives: records, and pieces of records that blocks cut.
RECORD, CLOSING, BEGINNING, BETWEEN = 0, 1, 2, 3
# Behind all records that a block holds whole.
LAST = 1 << 40
# A row of the table of blocks takes less than this.
BLOCK_ROW_BYTES = 512


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside quotes; a quote opens at the beginning of a cell only."""
    begins, closed = not inside, False
    for piece in line.split(b'"')[:-1]:
        # Every piece is followed by a quote.
        if inside:
            inside, closed = False, True
            continue
        if piece:
            begins = piece.endswith((b",", b"\r"))
        elif closed:
            # Two quotes in a row stand for one.
            begins = True
        inside, closed, begins = begins, False, False
    return inside


def records_of(text: str) -> list[list[str]]:
    """Cells of whole records; those whose cells are all white space are left out."""
    return [row for row in csv.reader(io.StringIO(text, newline="")) if any(map(str.strip, row))]


def _decoded(data: bytes, encoding: str, source_file: str) -> str:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        raise ValueError(f"the file fits no encoding: {source_file}") from None


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source_file, block, seq, value``: lines without their line feed, in order of ``seq`` in a block.

    The file is spelled as Spark does; what it is called is found once per block.
    """
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value"),
        )
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that lie in one block."""
    files, blocks = batch.column(0), batch.column(1)
    if not batch.num_rows:
        return
    change = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    cuts = [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield files[a].as_py(), blocks[a].as_py(), batch.slice(a, b - a)


def _without_mark(line: bytes, block: int, first: bool) -> bytes:
    return line[len(BOM) :] if first and block == 0 and line.startswith(BOM) else line


def block_facts(lines: DataFrame, called: Callable[[DataFrame], DataFrame], encoding: str | None = None) -> DataFrame:
    """``source_file, block, path, inside, encoding``: how each block begins, and what its file is called and written in.

    A file is UTF-8 if all its lines are, else GB18030, unless ``encoding`` says what it is. ``called`` adds
    the ``path`` to rows with a ``source_file``.
    """

    def run(batches):
        names = ["source_file", "block", "from_outside", "from_inside", "good"]
        now, state = None, [False, True, True]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *state)], names=names)

        for batch in batches:
            for file, block, part in _runs(batch):
                first = (file, block) != now
                if first:
                    if now is not None:
                        yield row()
                    now, state = (file, block), [False, True, True]
                state[2] = state[2] and bool(pc.all(part.column(3)).as_py())
                at = pc.indices_nonzero(pc.is_valid(part.column(2)))
                for k, line in zip(at.to_pylist(), part.column(2).take(at).to_pylist(), strict=True):
                    line = _without_mark(line, block, first and k == 0)
                    after = ends_inside(line, False), ends_inside(line, True)
                    state[0], state[1] = after[state[0]], after[state[1]]
        if now is not None:
            yield row()

    # Only lines with quotes tell how a block ends.
    checked = lines.select(
        "source_file", "block", F.when(F.contains("value", F.lit(b'"')), F.col("value")).alias("value"),
        F.is_valid_utf8(F.col("value").cast("string")).alias("good"),
    )
    ends = settle(checked.mapInArrow(run, "source_file string, block long, from_outside boolean, from_inside boolean, good boolean"))
    # A block ends the same way however it begins, or as it begins, or the other way round. What counts
    # before a block is the last of the first kind, and how often it was turned round since.
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turned = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(until)
    placed = ends.withColumn("turns", turned).withColumn("fixed", fixed)
    since = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(
        F.last(F.when(F.col("fixed").isNotNull(), F.col("turns")), ignorenulls=True).over(before), F.lit(0)
    )
    start = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(False))
    judged = F.when(F.min("good").over(Window.partitionBy("source_file")), F.lit(UTF8)).otherwise(F.lit(GB18030))
    facts = placed.select(
        *BLOCK_KEY, (start != (since % 2 == 1)).alias("inside"), (F.lit(encoding) if encoding else judged).alias("encoding")
    )
    return settle(called(facts).select(*BLOCK_KEY, "path", "inside", "encoding"))


def _beside(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines with the facts of their block, still in order; ``source_file`` is what the file is called."""
    small = facts.count() * BLOCK_ROW_BYTES <= BROADCAST_BYTES
    joined = lines.join(F.broadcast(facts) if small else facts.hint("shuffle_hash"), BLOCK_KEY).select(
        F.col("path").alias("source_file"), "block", "value", "inside", "encoding", "seq"
    )
    if small:
        return joined.drop("seq")
    # A block is of bounded size, so no task gets more than a few of them.
    return joined.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "seq")


PARSED = "source_file string, block long, place long, kind int, encoding string, cells array<string>, piece binary"


def parsed(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Records of every block, numbered by ``place``, and the pieces of records that blocks cut."""

    def run(batches):
        csv.field_size_limit(sys.maxsize)
        names = ["source_file", "block", "place", "kind", "encoding", "cells", "piece"]
        now, encoding = None, None
        # Lines of a record that is open, how it began, and how many records the block had so far.
        pending: list[bytes] = []
        inside, kind, place = False, BEGINNING, 0

        def rows(kinds, cells, pieces):
            nonlocal place
            n = len(kinds)
            places = [place + i for i in range(n)] if kinds[0] == RECORD else [LAST] * n
            place += n if kinds[0] == RECORD else 0
            columns = [
                pa.array([now[0]] * n), pa.array([now[1]] * n), pa.array(places), pa.array(kinds, pa.int32()),
                pa.array([encoding] * n), pa.array(cells, pa.list_(pa.string())), pa.array(pieces, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def open_piece():
            return rows([BETWEEN if kind == CLOSING else BEGINNING], [None], [b"\n".join(pending)])

        for batch in batches:
            for file, block, part in _runs(batch):
                first = (file, block) != now
                if first:
                    if now is not None and pending:
                        yield open_piece()
                    now, encoding = (file, block), part.column(4)[0].as_py()
                    pending, inside, place = [], part.column(3)[0].as_py(), 0
                    kind = CLOSING if inside else BEGINNING
                whole: list[bytes] = []
                own = part.column(2).to_pylist()
                own[0] = _without_mark(own[0], block, first)
                quoted = pc.indices_nonzero(pc.greater_equal(pc.find_substring(part.column(2), b'"'), 0)).to_pylist()
                done = 0
                for at in quoted:
                    # Lines without quotes belong where the line before them ends.
                    (pending if inside else whole).extend(own[done:at])
                    done = at + 1
                    inside = ends_inside(own[at], inside)
                    pending.append(own[at])
                    if inside:
                        continue
                    if kind == CLOSING:
                        yield rows([CLOSING], [None], [b"\n".join(pending)])
                    else:
                        whole.append(b"\n".join(pending))
                    pending, kind = [], BEGINNING
                (pending if inside else whole).extend(own[done:])
                found = records_of(_decoded(b"\n".join(whole), encoding, file)) if whole else []
                if found:
                    yield rows([RECORD] * len(found), found, [None] * len(found))
        if now is not None and pending:
            yield open_piece()

    return _beside(lines, facts).mapInArrow(run, PARSED)


def put_together(pieces: DataFrame) -> DataFrame:
    """Records of the pieces that blocks cut, at the end of the block in which they begin."""
    order = Window.partitionBy("source_file").orderBy("block", (F.col("kind") == BEGINNING).cast("int"))
    number = F.sum((F.col("kind") == BEGINNING).cast("int")).over(order)
    whole = (
        pieces.withColumn("record", number).groupBy("source_file", "record")
        .agg(
            F.min("block").alias("block"), F.min("encoding").alias("encoding"),
            F.array_sort(F.collect_list(F.struct("block", F.col("kind").isin(BEGINNING).alias("late"), "piece"))).alias("parts"),
        )
        .select("source_file", "block", "encoding", F.col("parts.piece").alias("pieces"))
    )

    def run(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            out = {"source_file": [], "block": [], "place": [], "cells": []}
            for row in batch.to_pylist():
                text = _decoded(b"\n".join(row["pieces"]), row["encoding"], row["source_file"])
                for i, cells in enumerate(records_of(text)):
                    for name, value in zip(out, (row["source_file"], row["block"], LAST + i, cells), strict=True):
                        out[name].append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return whole.mapInArrow(run, "source_file string, block long, place long, cells array<string>")


def csv_records(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``source_file, block, place, cells``: every record once; ``place`` orders the records of a block."""
    found = store(parsed(lines, facts), "records")
    whole = found.where(F.col("kind") == RECORD).select(*BLOCK_KEY, "place", "cells")
    pieces = found.where(F.col("kind") != RECORD).drop("cells", "place")
    return whole.unionByName(put_together(pieces))
