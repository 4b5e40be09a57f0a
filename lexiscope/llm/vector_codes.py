"""Vector codes: product quantisation by Lloyd rounds that compare only what can have changed.

Vectors of integers are cut into equal parts, and each part position has a codebook of up to 256 entries.
A round keeps, for every part of every vector, its entry and the exact squared distance to it. When the
codebook moves, a part whose own entry stayed fixed compares the stored distance with the entries that moved
only: no fixed entry has become nearer. A part whose own entry moved is scanned again in full. Ties go to
the lower index in either case, so the codes equal those of full scans.

A round is one pass: it writes the vectors with their new codes and, as rows of the same table, the sums and
counts of its task for each entry, from which the next codebook is added up. A codebook has 256 vectors whatever
the size of the table, and is all that comes to the driver or is broadcast. The table before is then deleted."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiscope.llm.common import materialise, slices
from lexiscope.session import discard, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this have no code; sums of 10^10 smaller ones fit decimal(38,0).
MOST = 1e25
LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as doubles that are whole numbers; exact, as the scale is a power of two."""
    return np.floor(x.astype(np.float64) * scale)


def fits(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether squared distances can be worked out in doubles without rounding."""
    top = max(float(abs(x).max(initial=0)), float(abs(book).max(initial=0)))
    return 4 * x.shape[1] * top * top < 1 << 53


def as_ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of the book for each row of x, the lower index in a tie, and the squared distance."""
    if fits(x, book):
        c = book.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    at, best, ints = np.zeros(len(x), np.int64), np.zeros(len(x), object), as_ints(book)
    for i, row in enumerate(as_ints(x)):  # numbers too large for doubles: whole numbers of any size
        d = ((ints - row) ** 2).sum(axis=1)
        at[i] = d.argmin()
        best[i] = d[at[i]]
    return at, best


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part position: the rows x, their entries and distances so far, and which entries have moved since -> both anew.

    A negative distance says that none is stored."""
    code, dist = code.astype(np.int64), dist.copy()
    again = np.flatnonzero(moved[code] | (dist < 0))
    rest = np.flatnonzero(~(moved[code] | (dist < 0)))
    which = np.flatnonzero(moved)
    if len(rest) and len(which):
        at, d = nearest(x[rest], book[which])
        at = which[at]
        better = (d < dist[rest]) | (d == dist[rest]) & (at < code[rest])
        code[rest[better]], dist[rest[better]] = at[better], d[better].astype(np.int64)  # smaller than one that fits
    if len(again):
        at, d = nearest(x[again], book)
        code[again] = at
        dist[again] = d if d.dtype == np.int64 else [v if v <= LONG else -1 for v in d]
    return code, dist


def round_of(rows: DataFrame, books: np.ndarray, moved: np.ndarray, scale: int) -> DataFrame:
    """rows(vec_id, label, vec, code, dist) -> the same with new codes, and rows (slot, total) of sums: components by part,
    entry and place, then counts by part and entry."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast((books, moved))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + StructType.fromDDL("slot int, total decimal(38,0)").fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        books, moved = sent.value
        sums = np.zeros(parts * entries * (width + 1), np.int64)
        for batch in batches:
            for b in slices(batch):
                n = b.num_rows
                x = whole(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width), scale)
                old_code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, parts)
                old_dist = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, parts)
                codes, dists = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
                if sums.dtype != object and not fits(x.reshape(n, -1), books[0]):
                    sums = sums.astype(object)
                for p in range(parts):
                    codes[:, p], dists[:, p] = assign(x[:, p], books[p], moved[p], old_code[:, p], old_dist[:, p])
                    at = p * entries
                    for i in range(width):
                        col = x[:, p, i]
                        if sums.dtype == object:
                            for e, v in zip(codes[:, p].tolist(), col.tolist(), strict=True):
                                sums[(at + e) * width + i] += int(v)
                        else:
                            sums[at * width + i : (at + entries) * width : width] += np.bincount(codes[:, p], col, entries).astype(np.int64)
                    sums[parts * entries * width + at :][:entries] += np.bincount(codes[:, p], minlength=entries)
                both = [pa.array([row.tobytes() for row in codes], pa.binary()), pa.ListArray.from_arrays(np.arange(0, n * parts + 1, parts, dtype=np.int32), pa.array(dists.reshape(-1))).cast(arrow.field(4).type)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *both, pa.nulls(n, pa.int32()), pa.nulls(n, arrow.field(6).type)], schema=arrow)
        used = np.flatnonzero(sums != 0)
        # an entry whose components add up to zero still has its count, and no sum is zero
        total = pa.array([Decimal(int(v)) for v in sums[used]], arrow.field(6).type)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), arrow.field(i).type) for i in range(5)], pa.array(used, pa.int32()), total], schema=arrow)

    return rows.mapInArrow(run, schema)


def next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after an update: floor of the mean, by place; entries without parts stay."""
    parts, entries, width = books.shape
    found = {r["slot"]: int(r["total"]) for r in state.filter("slot is not null").groupBy("slot").agg(F.sum("total").alias("total")).collect()}
    new = books.copy()
    for k in range(parts * entries):
        n = found.get(parts * entries * width + k, 0)
        if n:
            new[k // entries, k % entries] = [found.get(k * width + i, 0) // n for i in range(width)]
    return new


def sha(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def sound(vector: Column) -> Column:
    """A vector without null, infinite or other components that are no numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vectors(key, vector, label) -> vec_id, label, code, error, label_error, codebooks_sha256 for each row with a sound vector.

    Rows whose vector is null or has a null, infinite or NaN component are left out. A component x counts as
    floor(scale x); `scale` is a power of two. The first codebooks are the parts of the vectors with the `entries`
    smallest keys (fewer if there are fewer); of rows that share a key those with the smaller vector come first, and
    a null key comes last. code has two hex digits for each part; error is the sum of the squared distances,
    or the largest long if it is beyond that; label_error adds the errors of equal labels, nulls together. Repeated
    rows each count. A vector whose length isn't the one that most vectors have (the larger in a tie), or with a component
    beyond 10^25, stays with a null code and error and takes no part in the codebooks. An empty table gives
    an empty result. Other columns are ignored."""
    spark = prepare(vectors.sparkSession)
    every = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec")).filter(sound(F.col("vec")))
    lengths = every.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    length = lengths["n"] if lengths else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    usable = (F.size("vec") == length) & F.forall("vec", lambda v: F.abs(v) < MOST)
    rows = every.filter(usable).withColumns({"code": F.lit(bytes(parts)), "dist": F.array_repeat(F.lit(-1).cast("long"), parts)})
    first = [r["vec"] for r in rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()]
    start = whole(np.array(first, np.float64).reshape(len(first), parts, length // parts), scale)
    books = np.array([[[int(v) for v in entry[p]] for entry in start.tolist()] for p in range(parts)], object).reshape(parts, len(first), length // parts)
    moved, before = np.ones(books.shape[:2], bool), None
    for n in range(rounds + 1):
        if not len(first):
            break
        state = materialise(round_of(rows, books.astype(np.float64) if abs(books).max(initial=0) < 1 << 52 else books, moved, scale))
        if before is not None:
            discard(before)
        rows, before = state.filter("slot is null").drop("slot", "total"), state
        if n < rounds:
            new = next_books(state, books)
            moved, books = (new != books).any(axis=2), new
    coded = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), F.when(F.forall("dist", lambda d: d >= 0), F.least(F.aggregate("dist", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)")), F.lit(LONG))).otherwise(F.lit(LONG)).cast("long").alias("error")).unionByName(every.filter(~usable).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(sha(books)).alias("codebooks_sha256"))


def oracle(table: str = "embeddings", dims: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rows of op11 in SQL, by full scans; for vectors of `dims` components."""
    w = dims // parts
    near = lambda n: f"""
a{n} as materialized (select vec_id, part, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := entry)) as best from p join b{n} using (part) group by vec_id, part)"""  # noqa: E731
    moved = lambda n: f""",
m{n} as (select part, entry, i, floor(sum(x[i]) / count(*)) as v from (select p.part, best.e as entry, x, unnest(generate_series(1, {w})) as i from p join a{n} using (vec_id, part)) group by part, entry, i),
b{n + 1} as materialized (select part, entry, coalesce(any_value(n.c), any_value(b{n}.c)) as c from b{n} left join (select part, entry, list(v order by i) as c from m{n} group by part, entry) n using (part, entry) group by part, entry),"""  # noqa: E731
    steps = "".join(near(n) + moved(n) for n in range(rounds)) + near(rounds)
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as x from {table}
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, unnest(generate_series(0, {parts - 1})) as part, list_slice(x, part * {w} + 1, (part + 1) * {w}) as x from v),
b0 as materialized (select part, dense_rank() over (order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from v order by vec_id limit {entries})),
{steps},
s as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by part, entry, i)) as codebooks_sha256 from (select part, entry, unnest(c) as y, unnest(generate_series(1, {w})) as i from b{rounds})),
f as (select vec_id, string_agg(lower(printf('%02x', cast(best.e as integer))), '' order by part) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by vec_id)
select f.vec_id, f.code, f.error, cast(sum(f.error) over (partition by v.label) as bigint) as label_error, s.codebooks_sha256 from f join v using (vec_id) cross join s"""
