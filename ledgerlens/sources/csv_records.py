"""Records of CSV files whose quoted fields go over line ends, read in splits.

Whether a line is inside a quoted field depends on all lines before it.  A line is therefore read as a function of
two states (outside, inside): where does it end when it starts in either?  Such functions compose, so

1. each block (split) of a file is one function, composed of its lines in a single narrow pass;
2. the state that a block starts in is the composition of the blocks before it, by windows over one row per block;
3. each block is cut into records on its own: a record begins at every line that starts outside.  Only what goes over
   a block's edge (its last record's end, in the next block) is put together afterwards.

A quote opens a field only where the field begins, so an inch mark inside a value opens nothing; doubled quotes stand
for one; after a closing quote everything up to the next comma belongs to the field.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialise

# --- fixed values: the functions of two states, as (from outside) + 2 * (from inside) -----------
TO_OUTSIDE, TURN, KEEP, TO_INSIDE = 0, 1, 2, 3
# ------------------------------------------------------------------------

# Whole fields from the start on, one after another (doubled quotes are taken out before).
WHOLE_FIELD = r'\G(?:"[^"]*+"[^,]*+|[^",][^,]*+|)(?:,|\z)'


def ends_inside(line: Column) -> Column:
    """Does a line that starts outside end inside a quoted field?"""
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), WHOLE_FIELD, "") != ""


def line_function(line: Column) -> Column:
    """The line's function; a line that starts inside reads like one that starts with a quote."""
    quoted = F.contains(line, F.lit('"'))
    out = F.when(quoted, ends_inside(line)).otherwise(False)
    inside = F.when(quoted, ends_inside(F.concat(F.lit('"'), line))).otherwise(True)
    return (out.cast("int") + 2 * inside.cast("int")).cast("tinyint")


def lines(spark: SparkSession, path: str, latin1: bool = False) -> DataFrame:
    """value, file, block (offset of the split in the file), fn (the line's function)."""
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin1 else F.col("value")
    rows = spark.read.text(path).select(text.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("fn", line_function(F.col("value")))


def _runs(batch, *names):
    """(start, end) of the stretches of a batch that belong to one block of one file."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return []
    change = np.zeros(batch.num_rows - 1, bool)
    for n in names:
        c = batch.column(batch.schema.get_field_index(n))
        change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(change) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]))


def _states(fn, state: int):
    """State before each line and after the last: the last line that settles it, and the turns since."""
    import numpy as np

    settles = (fn == TO_OUTSIDE) | (fn == TO_INSIDE)
    turns = np.concatenate([[0], np.cumsum(fn == TURN)])
    last = np.maximum.accumulate(np.where(settles, np.arange(1, len(fn) + 1), 0))
    last = np.concatenate([[0], last])
    base = np.concatenate([[state], (fn == TO_INSIDE).astype(int)])[last]
    after = base ^ ((turns - turns[last]) & 1)
    return after[:-1], int(after[-1])


def block_functions(rows: DataFrame) -> DataFrame:
    """file, block, fn: one composed function per block; bad: has it undecodable bytes; open: may a line of it end in a quoted field?"""

    def run(batches):
        import pyarrow as pa

        key, held, bad, open_ = None, None, False, False
        for b in batches:
            out = []
            for a, z in _runs(b, "file", "block"):
                here = (b.column(0)[a].as_py(), b.column(1)[a].as_py())
                if here != key:
                    if key is not None:
                        out.append((*key, held[0] + 2 * held[1], bad, open_))
                    key, held, bad, open_ = here, (0, 1), False, False
                fn = b.column(2)[a:z].to_numpy()
                held = (_states(fn, held[0])[1], _states(fn, held[1])[1])
                bad, open_ = bad or bool(b.column(3)[a:z].true_count), open_ or bool((fn & 1).any())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, held[0] + 2 * held[1], bad, open_)))], schema)

    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("fn", pa.int8()), ("bad", pa.bool_()), ("open", pa.bool_())])
    return rows.select("file", "block", "fn", (~F.is_valid_utf8("value")).alias("bad")).mapInArrow(run, "file string, block long, fn tinyint, bad boolean, open boolean")


def start_states(functions: DataFrame) -> DataFrame:
    """file, block, inside: the state each block starts in, composed over the blocks before it (one row a block)."""
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = functions.withColumn("turns", F.sum((F.col("fn") == TURN).cast("int")).over(so_far))
    settled = F.when(F.col("fn").isin(TO_OUTSIDE, TO_INSIDE), F.struct((F.col("fn") == TO_INSIDE).cast("int").alias("state"), "turns"))
    last = F.last(settled, ignorenulls=True).over(before)
    turned = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    return counted.select("file", "block", ((F.coalesce(last["state"], F.lit(0)) + turned) % 2 == 1).alias("inside"))


# What a row of the cut is: a whole record, lines that end a record of the block before, a record that goes on, a file's header.
WHOLE, HEAD, TAIL, HEADER = 0, 1, 2, 3
KINDS = "kind tinyint, file string, block long, record string"


def _cut(batches):
    """Cut the lines of each block (value, file, block, fn, inside) into records and the fragments at its edges."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int8()), ("file", pa.string()), ("block", pa.int64()), ("record", pa.string())])
    key, state, held, kind, headed = None, 0, [], WHOLE, True
    names = ("kind", "file", "block", "record")

    def rows(out):
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    def flush(whole: bool):
        """The open record of a block: complete, or cut off by the block's end."""
        nonlocal held, headed, kind
        text, what = "\n".join(held), kind
        if what == WHOLE and (not text.strip() and whole):
            held = []
            return []
        if what == WHOLE and not whole:
            what = TAIL
        if what == WHOLE and not headed:
            what, headed = HEADER, True
        held, kind = [], WHOLE
        return [(what, *key, text)]

    for b in batches:
        out = []
        for a, z in _runs(b, "file", "block"):
            here = (b.column(1)[a].as_py(), b.column(2)[a].as_py())
            if here != key:
                if key is not None and held:
                    out += flush(whole=state == 0)
                key, state, held = here, int(b.column(4)[a].as_py()), []
                kind, headed = (HEAD if state else WHOLE), here[1] != 0
            before, state = _states(b.column(3)[a:z].to_numpy(), state)
            values = b.column(0)[a:z]
            starts = np.flatnonzero(before == 0)
            first = int(starts[0]) if len(starts) else z - a
            if first:  # these lines go on with the open record
                held += values[:first].to_pylist()
            if not len(starts):
                continue
            if held:
                out += flush(whole=True)
            ends = np.append(starts[1:], z - a)
            lone = ends - starts == 1
            lone[-1] = False  # may go on in the next batch
            if not headed:
                lone[:] = False
            for i in np.flatnonzero(~lone).tolist():
                held = values[int(starts[i]):int(ends[i])].to_pylist()
                if i < len(starts) - 1:
                    out += flush(whole=True)
            plain = values.take(pa.array(starts[lone]))
            if len(plain):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(plain), np.int8)), pa.array([here[0]] * len(plain)), pa.array(np.full(len(plain), here[1])), plain], schema=schema)
        if out:
            yield rows(out)
    if key is not None and held:
        yield rows(flush(whole=state == 0))


def header(spark: SparkSession, path: str, latin1: bool = False) -> str:
    """The first record of the first file; only the start of that file is read."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return ""
    start = lines(spark, unquote(files[0]), latin1).where(F.col("block") == 0)
    row = start.select("value", "file", "block", "fn", F.lit(False).alias("inside")).mapInArrow(_cut, KINDS).where(F.col("kind") == HEADER).select("record").first()
    return row["record"] if row else ""


def records(rows: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Column record: the CSV records of the files but for each one's header, line breaks kept as ``\\n``.
    ``functions``: those of the blocks if at hand."""
    # blocks that start inside a quoted field: one row a block at most, which the driver's own file listing outnumbers
    inside = materialise(start_states(block_functions(rows) if functions is None else functions).where("inside").select(F.col("file").alias("f"), F.col("block").alias("b"), "inside"), "csv-blocks")
    known = rows.join(F.broadcast(inside), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")
    cut = known.select("value", "file", "block", "fn", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_cut, KINDS)
    whole = cut.where((F.col("kind") == WHOLE) & (F.trim("record") != "")).select("record")
    if inside.isEmpty():
        # no record goes over a block's edge; one that the file's end cuts off is a record as well
        return cut.where((F.col("kind") == TAIL) | ((F.col("kind") == WHOLE) & (F.trim("record") != ""))).select("record")
    edges = cut.where(F.col("kind").isin(HEAD, TAIL))
    # a record that goes on, then the ends that follow it: at most two rows a block
    place = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (edges.withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(place)).groupBy("file", "nth")
              .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"))
              .select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    return whole.unionByName(joined)
