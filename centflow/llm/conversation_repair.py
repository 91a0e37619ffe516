"""Structure repair of conversations of any length: faults, and the cheapest edits to ``(s?(ua)+)?``.

Rows are range-partitioned and sorted by conversation and turn, so that every task streams over a block of whole
conversations but for its first and last one, which may lie in other blocks too. Conversations inside a block are
repaired there by ``audit_dp``. What lies at the border of a block, or is longer than ``CHUNK`` rows or ``CHUNK_BYTES``
of text, is stored in chunks and repaired in four steps that never hold more than a chunk: first occurrences of
texts by an aggregation over their digests; costs and order of the best audits between all states, chunk by
chunk; the states at the chunks' borders, from one small row per chunk; then the audits between these, chunk by chunk. Only the
digest of a repaired conversation, which is one chain by its definition, is a stream over its text: the task keeps
the state of the hash and a batch, not the text. Audits are put together as the value of the output row that they are.

The order of rows is (turn, nulls first; role; first 32 characters of the text; digest of role and text): equal rows
of one turn are adjacent. Defined results: a null role or text is one space; a null conversation is one of its
own; rows of equal turns are all kept; a conversation of which no row is left has zeros, an empty audit and the digest
of an empty text; an empty table gives no rows. Only the four named columns are read.
"""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from centflow.llm import audit_dp
from centflow.llm.audit_dp import BLANK, CUT, DUPLICATE, SOUND
from centflow.session import written

#: Rows, and bytes of text and roles, of a chunk of a conversation that is not repaired in one piece.
CHUNK, CHUNK_BYTES = 16_384, 8 << 20
#: Fixed value: the white space of the word pattern.
SPACE = " \t\n\x0b\f\r"
_CHUNK_BITS, _ROW_BITS = 24, 33
#: Finished conversations of one Arrow batch.
_DONE = 2_000

_RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


@dataclass
class Repair:
    """What a conversation gets."""

    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    audit: str = ""
    repaired_sha256: str = hashlib.sha256().hexdigest()


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone, copy, row): a twentieth of the rows each dropped (``gone``), emptied, without
    end marks, repeated and said by the user, as a checksum of conversation and turn decides.
    """
    conv_, turn_, role_, said = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text))
    what = F.crc32(F.concat(conv_, F.lit(":"), turn_)) % 20
    return df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(what == 4, "user").otherwise(role_).alias("role"),
        F.when(what <= 1, "").when(what == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        (what == 0).alias("gone"), F.monotonically_increasing_id().alias("row"),
        F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _in_order(rows: DataFrame) -> DataFrame:
    shown = F.rtrim("text", F.lit(SPACE))
    flagged = rows.withColumns({
        "blank": shown == "", "cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?"),
        # the length tells where the role ends
        "digest": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
        "_start": F.left("text", F.lit(32))})
    keys = ["conv", "turn", "role", "_start", "digest", "row", "copy"]
    return (flagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .select("conv", "turn", "role", "text", "gone", "blank", "cut", "digest"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv and the fields of ``Repair``) of every conversation of rows (conv, turn, role, text, gone, copy, row)."""
    ordered = _in_order(rows)
    # rows of results have none of the columns of rows, and the other way round
    raw = [T.StructField(f.name, f.dataType) for f in ordered.schema.fields]
    raw += [T.StructField("pos", T.LongType()), T.StructField("chunk", T.LongType())]
    result = T.StructType.fromDDL(_RESULT)
    out = T.StructType([*raw, *(T.StructField(f"r_{f.name}", f.dataType) for f in result.fields)])
    stored = written(ordered.mapInArrow(partial(_blocks, chunk=chunk), out), "conversations")
    whole = stored.where("chunk is null").select("conv", *(F.col(f"r_{n}").alias(n) for n in _NAMES))
    return whole.unionByName(_long(stored.where("chunk is not null").select(*(f.name for f in raw))))


def _initial_rows(roles: list[str], blank: list[bool], cut: list[bool],
                  seen: list[bool]) -> list[tuple[str, str]]:
    """(initial, fault) of live rows."""
    return [(role[:1], BLANK if b else DUPLICATE if again else CUT if c else SOUND)
            for role, b, c, again in zip(roles, blank, cut, seen)]


def _repeats(roles: list[str], texts: list[str]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    out = []
    for pair in zip(roles, texts):
        out.append(pair in seen)
        seen.add(pair)
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _counts(rows: list[tuple[str, str]]) -> dict[str, int]:
    faults = [f for _, f in rows]
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT)}


def _lines(audit: str, roles: list[str], texts: list[str], state: int = audit_dp.START) -> list[str]:
    return [f"{role}:{text}" for role, text in audit_dp.repaired(audit, list(zip(roles, texts)), state)]


def solve(turns: list[int | None], roles: list[str], texts: list[str], blank: list[bool], cut: list[bool]) -> Repair:
    """The repair of one conversation's rows in order."""
    if not roles:
        return Repair()
    rows = _initial_rows(roles, blank, cut, _repeats(roles, texts))
    known = {t for t in turns if t is not None}
    cost, audit = audit_dp.repair(rows)
    lines = "\n".join(_lines(audit, roles, texts))
    return Repair(max(known) - min(known) + 1 - len(known) if known else 0, **_counts(rows),
                  illegal=_illegal([i for i, _ in rows]), cost=cost, audit=audit,
                  repaired_sha256=hashlib.sha256(lines.encode()).hexdigest())


class _Block:
    """One task's stream of sorted rows: whole conversations are repaired, others leave as chunks."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        block = TaskContext.get().partitionId()
        self.pos, self.chunk = block << _ROW_BITS, block << _CHUNK_BITS
        self.pending: list[pa.RecordBatch] = []
        self.rows = self.bytes = 0
        self.first, self.long = True, False
        self.done: list[tuple] = []

    def take(self, part: pa.RecordBatch) -> Iterator[pa.Table]:
        """More rows of the present conversation."""
        self.pending.append(part)
        self.rows += part.num_rows
        self.bytes += sum(part.column(c).nbytes for c in ("role", "text"))
        if self.rows >= self.limit or self.bytes >= CHUNK_BYTES:
            self.long = True
            yield from self.flush()

    def flush(self) -> Iterator[pa.Table]:
        if self.pending:
            rows = pa.Table.from_batches(self.pending)
            rows = rows.append_column("pos", pa.array(range(self.pos, self.pos + len(rows)), pa.int64()))
            yield rows.append_column("chunk", pa.array([self.chunk] * len(rows), pa.int64()))
            self.pos, self.chunk = self.pos + len(rows), self.chunk + 1
        self.pending, self.rows, self.bytes = [], 0, 0

    def close(self, last: bool) -> Iterator[pa.Table]:
        """The present conversation has no more rows in this block."""
        if self.first or self.long or last:
            yield from self.flush()
        elif self.pending:
            rows = pa.Table.from_batches(self.pending)
            conv = rows["conv"][0].as_py()
            rows = rows.filter(pc.invert(rows["gone"]))
            found = solve(*(rows[c].to_pylist() for c in ("turn", "role", "text", "blank", "cut")))
            self.done.append((conv, found))
            self.pending, self.rows, self.bytes = [], 0, 0
            if len(self.done) >= _DONE:
                yield from self.results()
        self.first = self.long = False

    def results(self) -> Iterator[pa.Table]:
        if self.done:
            yield _result_table(self.done)
            self.done = []


def _kind(name: str) -> pa.DataType:
    return pa.string() if name in ("audit", "repaired_sha256") else pa.int64()


def _result_table(done: list[tuple[object, Repair]]) -> pa.Table:
    columns = {f"r_{name}": pa.array([getattr(r, name) for _, r in done], _kind(name)) for name in _NAMES}
    return pa.table({"conv": pa.array([c for c, _ in done]), **columns})


def _parts(batch: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
    """A sorted batch by conversation, and no part above a chunk's rows."""
    codes = batch.column("conv").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1]), len(codes)]
    for a, b in zip(starts, starts[1:]):
        for i in range(a, b, chunk):
            yield batch.slice(i, min(chunk, b - i))


def _blocks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Stored rows of a block: results of whole conversations, rows and chunk numbers of others."""
    block, schema = _Block(chunk), None
    start = now = object()

    def shaped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f.type for f in schema} | {"pos": pa.int64(), "chunk": pa.int64()}
        kinds |= {f"r_{n}": _kind(n) for n in _NAMES}
        columns = [rows[c].cast(t) if c in rows.column_names else pa.nulls(len(rows), t) for c, t in kinds.items()]
        yield from pa.table(columns, list(kinds)).to_batches()

    for batch in batches:
        schema = schema or batch.schema
        for part in _parts(batch, chunk) if batch.num_rows else ():
            conv = part.column("conv")[0].as_py()
            if conv != now:
                for rows in block.close(last=False) if now is not start else ():
                    yield from shaped(rows)
                now = conv
            for rows in block.take(part):
                yield from shaped(rows)
    if schema is not None:
        for rows in (*block.close(last=True), *block.results()):
            yield from shaped(rows)


def _long(raw: DataFrame) -> DataFrame:
    """The repairs of conversations stored in chunks."""
    conv = raw.schema["conv"].dataType.simpleString()
    live = raw.where("not gone")
    firsts = (live.where("not blank").groupBy("conv", "digest").agg(F.min(F.struct("pos", "chunk")).alias("at"))
              .groupBy("at.chunk").agg(F.collect_list("at.pos").alias("firsts")))
    firsts = written(firsts, "firsts")
    chunks = written(raw.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(
        _summary, f"conv {conv}, chunk long, rows long, first_initial string, last_initial string, blank long, "
                  "duplicate long, truncated long, illegal long, costs array<long>, places array<long>"), "chunks")
    plans = written(chunks.groupBy("conv").applyInArrow(
        _choose, f"conv {conv}, chunk long, entry int, exit int, tail int, blank long, duplicate long, truncated long, "
                 "illegal long, cost long"), "plans")
    # the stream of a conversation is in the order of its chunks
    pieces = written(raw.groupBy("chunk").cogroup(firsts.join(plans.select("chunk", "entry", "exit", "tail"), "chunk", "right")
                     .groupBy("chunk")).applyInArrow(_edits, f"conv {conv}, chunk long, audit string, lines string"), "edits")
    spread = pieces.repartition("conv").sortWithinPartitions("conv", "chunk")
    hashed = spread.select("conv", "audit", "lines").mapInArrow(_digests, f"conv {conv}, audit string, repaired_sha256 string")
    turns = live.groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    totals = plans.groupBy("conv").agg(*(F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))
    return (totals.join(hashed.withColumnRenamed("conv", "_h"), F.col("conv").eqNullSafe(F.col("_h")))
            .join(gaps.withColumnRenamed("conv", "_g"), F.col("conv").eqNullSafe(F.col("_g")), "left")
            .withColumn("gaps", F.coalesce("gaps", F.lit(0))).select("conv", *_NAMES))


def _live(rows: pa.Table, firsts: pa.Table) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Roles, texts and (initial, fault) of a chunk's live rows in order."""
    rows = rows.filter(pc.invert(rows["gone"])).sort_by("pos")
    first = set(firsts["firsts"][0].as_py() or ()) if len(firsts) else set()
    roles, texts, pos = (rows[c].to_pylist() for c in ("role", "text", "pos"))
    seen = [p not in first for p in pos]
    return roles, texts, _initial_rows(roles, rows["blank"].to_pylist(), rows["cut"].to_pylist(), seen)


def _summary(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """Costs and places of the audits between all states of a chunk, its counts and its ends."""
    roles, _, live = _live(rows, firsts)
    part = audit_dp.stretch(live)
    one = {"conv": rows["conv"][0].as_py(), "chunk": rows["chunk"][0].as_py(), "rows": len(roles),
           "first_initial": roles[0][:1] if roles else None, "last_initial": roles[-1][:1] if roles else None,
           **_counts(live), "illegal": _illegal([i for i, _ in live]),
           "costs": sum(part.costs, []), "places": sum(part.places, [])}
    kinds = {"conv": rows.schema.field("conv").type, "first_initial": pa.string(), "last_initial": pa.string(),
             "costs": pa.list_(pa.int64()), "places": pa.list_(pa.int64())}
    return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in one.items()})


def _choose(chunks: pa.Table) -> pa.Table:
    """States at the borders of the chunks of a conversation, and its counts."""
    rows = chunks.sort_by("chunk").to_pylist()
    squares = [[r[c][4 * i:4 * i + 4] for i in range(4)] for r in rows for c in ("costs", "places")]
    cost, path, tail = audit_dp.chain([audit_dp.Stretch(a, b) for a, b in zip(squares[::2], squares[1::2])])
    ends = [(r["first_initial"], r["last_initial"]) for r in rows if r["rows"]]
    illegal = sum(r["illegal"] for r in rows) + sum(_illegal([a[1], b[0]]) for a, b in zip(ends, ends[1:]))
    n = len(rows)
    columns = {"conv": pa.array([r["conv"] for r in rows], chunks.schema.field("conv").type),
               "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
               "entry": pa.array([a for a, _ in path], pa.int32()), "exit": pa.array([b for _, b in path], pa.int32()),
               "tail": pa.array([0] * (n - 1) + [tail], pa.int32())}
    totals = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")} | {"illegal": illegal, "cost": cost}
    return pa.table({**columns, **{c: pa.array([v] * n, pa.int64()) for c, v in totals.items()}})


def _edits(rows: pa.Table, plan: pa.Table) -> pa.Table:
    """A chunk's part of the audit and of the repaired lines; null lines if it has none."""
    roles, texts, live = _live(rows, plan)
    entry, exit_, tail = (plan[c][0].as_py() for c in ("entry", "exit", "tail"))
    audit = audit_dp.between(live, entry, exit_) + "I" * tail
    lines = _lines(audit, roles, texts, entry)
    return pa.table({"conv": rows["conv"].combine_chunks().slice(0, 1), "chunk": rows["chunk"].combine_chunks().slice(0, 1),
                     "audit": pa.array([audit], pa.string()), "lines": pa.array(["\n".join(lines) if lines else None], pa.string())})


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation of a stream in order."""
    now, audits, chain, some, kind = None, [], hashlib.sha256(), False, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["".join(audits)], pa.string()),
                                           pa.array([chain.hexdigest()], pa.string())], ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, audit, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if audits and conv != now:
                yield result()
                audits, chain, some = [], hashlib.sha256(), False
            now = conv
            audits.append(audit)
            if lines is not None:
                chain.update(b"\n" * some + lines.encode())
                some = True
    if audits:
        yield result()


def audit(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repair of every conversation of ``df`` after ``damage``."""
    found = repair(damage(df), chunk)
    return found.select(F.col("conv").alias("conv_id"), *_NAMES)
