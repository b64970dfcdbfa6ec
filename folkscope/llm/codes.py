"""Vector codes: product quantisation by k-means whose bounds follow net displacements of entries.

Vectors of integers are cut into parts, each part position has a codebook, and a vector's
code names each part's nearest entry. Codebooks come from a few rounds of k-means. A part
keeps, between rounds, an upper bound on the distance to its entry and lower bounds on
those to groups of entries, each stamped with the round at which it was last exact. The
codebooks of all rounds are kept. A bound of an earlier round is brought up to date by the
true displacement of an entry since its stamp, the norm of the sum of its moves, which is
at most the sum of their norms that bounds usually drift by (Newling and Fleuret, "Fast
k-means with accurate bounds", 2016). Only groups whose bound still reaches below the
upper bound are scanned again.

Each round is one pass: rows with their codes, bounds and stamps are written and read by
the next; per-task sums of each entry's parts are added by Spark, so codebooks alone (parts
x entries x components) reach the driver. A round's rows are deleted once the next
round's are written and added up.

Defined cases: rows whose vector is null or holds a null or non-finite component are left
out; a null vec_id is the largest of all, and of equal ones the lesser vector is the smaller;
rows that repeat a vec_id are vectors each; missing components of shorter vectors, and those
that fill the last part, count as 0; fewer rows than entries give fewer entries; an empty
table gives no rows; numbers of any size are exact, and errors beyond a 64-bit number
become its bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUPS = 4  # of entries that share a lower bound
ROWS = 8_192  # of one chunk in a task
LIMB_BITS = 40
EXACT = 1 << 53
FAR = 3e38  # no lower bound is larger, as it would not be a number of 32 bits
MOST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): rows that take part, components as double."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), "label", x.alias("x")).where(F.col("x").isNotNull() & finite)


def whole_numbers(lists: pa.Array, width: int, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x), a row per list, with zeros up to the width; Python's integers where 64 bits could overflow."""
    lengths, values = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten())
    at = np.arange(len(values)) + np.repeat(np.arange(len(lengths)) * width - (np.cumsum(lengths) - lengths), lengths)
    if exact:
        out = np.zeros(len(lengths) * width, object)
        out[at] = [scale * a // b for a, b in (float(v).as_integer_ratio() for v in values)]
    else:
        out = np.zeros(len(lengths) * width, np.int64)
        out[at] = np.floor(values * scale).astype(np.int64)
    return out.reshape(len(lengths), width)


class Codebooks:
    """The entries of every round, (parts, entries, components) each, and how far entries came between rounds."""

    def __init__(self, rounds: list[np.ndarray]):
        self.rounds, self.now = rounds, rounds[-1]
        self.groups = np.array_split(np.arange(self.now.shape[1]), GROUPS)
        # By stamp, part and entry: the norm of the sum of all moves since that round (inf beyond 32 bits).
        self.moved = np.stack([up(root(square_sum(self.now - then))) for then in rounds])
        # By stamp, part, group and entry assigned: the farthest that another entry of the group came.
        self.farthest = np.zeros((*self.moved.shape[:2], GROUPS, self.now.shape[1]))
        for g, members in enumerate(self.groups):
            for e in range(self.now.shape[1]):
                others = members[members != e]
                if len(others):
                    self.farthest[:, :, g, e] = self.moved[:, :, others].max(axis=2)


def square_sum(x: np.ndarray) -> np.ndarray:
    """Sums of squares over the last axis, exact."""
    return (x * x).sum(axis=-1) if x.shape[-1] else np.zeros(x.shape[:-1], x.dtype)


def root(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return np.sqrt(x.astype(float))
    return np.array([root_of(int(v)) for v in x.reshape(-1)], float).reshape(x.shape)


def root_of(x: int) -> float:
    try:
        return math.sqrt(x)
    except OverflowError:
        return math.inf


def up(x: np.ndarray) -> np.ndarray:
    """Bounds are kept as 32-bit numbers, rounded to the safe side."""
    with np.errstate(over="ignore"):
        return (x * (1 + 1e-6)).astype(np.float32)


def down(x: np.ndarray) -> np.ndarray:
    return np.minimum(x * (1 - 1e-6), FAR).astype(np.float32)


class Assigned:
    """Codes, bounds and stamps of some rows: (rows, parts), lower bounds and their stamps (rows, parts, groups)."""

    def __init__(self, code, upper, upper_stamp, lower, lower_stamp):
        self.code, self.upper, self.upper_stamp, self.lower, self.lower_stamp = code, upper, upper_stamp, lower, lower_stamp
        self.scanned = 0  # distances computed, to see what the bounds save

    @staticmethod
    def unknown(rows: int, parts: int) -> Assigned:
        """Bounds that exclude nothing."""
        shape = (rows, parts)
        lower, stamp = np.full((*shape, GROUPS), -np.inf, np.float32), np.zeros((*shape, GROUPS), np.uint8)
        return Assigned(np.zeros(shape, np.uint8), np.full(shape, np.inf, np.float32), np.zeros(shape, np.uint8), lower, stamp)

    def pack(self) -> list[pa.Array]:
        values = [self.code, self.upper, self.upper_stamp, self.lower, self.lower_stamp]
        return [pa.array([row.tobytes() for row in v], pa.binary()) for v in values]

    @staticmethod
    def unpack(columns: list[pa.Array], rows: int, parts: int) -> Assigned:
        kinds = (np.uint8, np.float32, np.uint8, np.float32, np.uint8)
        shapes = [(rows, parts)] * 3 + [(rows, parts, GROUPS)] * 2
        values = [
            np.frombuffer(b"".join(c.to_pylist()), kind).reshape(shape).copy() for c, kind, shape in zip(columns, kinds, shapes, strict=True)
        ]
        return Assigned(*values)


def assign(x: np.ndarray, books: Codebooks, state: Assigned) -> None:
    """Bring every part's code to its nearest entry of the newest codebook, ties to the lower index.

    ``x``: (rows, parts, components). A part is skipped if its upper bound, carried by its
    entry's displacement, lies below all its lower bounds, carried by those of the others.
    Else the upper bound is made exact, and groups that it still reaches are scanned.
    """
    stamp = len(books.rounds) - 1
    for p in range(x.shape[1]):
        entries, code = books.now[p], state.code[:, p].astype(np.int64)
        upper = state.upper[:, p] + books.moved[state.upper_stamp[:, p], p, code]
        lower = np.stack([state.lower[:, p, g] - books.farthest[state.lower_stamp[:, p, g], p, g, code] for g in range(GROUPS)], axis=1)
        # Sums of rounded numbers are rounded once more.
        upper, lower = upper * np.float32(1 + 1e-6), np.where(lower > 0, lower * np.float32(1 - 1e-6), lower * np.float32(1 + 1e-6))
        lower[:, [g for g, members in enumerate(books.groups) if not len(members)]] = np.inf
        open_ = np.flatnonzero(~(upper < lower.min(axis=1)))
        if not len(open_):
            continue
        best = square_sum(x[open_, p] - entries[code[open_]])
        state.upper[open_, p], state.upper_stamp[open_, p] = up(root(best)), stamp
        near = state.upper[open_, p].copy()  # of the entry assigned so far; groups above it hold no nearer one and no tie
        state.scanned += len(open_)
        was = code[open_]
        chosen, second = was.copy(), []
        for g, members in enumerate(books.groups):
            rows = np.flatnonzero(~(near < lower[open_, g])) if len(members) else np.zeros(0, np.int64)
            if not len(rows):
                continue
            part = x[open_[rows], p]
            distances = np.stack([square_sum(part - entries[e]) for e in members], axis=1)
            state.scanned += distances.size
            second.append((g, rows, distances))
            place = distances.argmin(axis=1)
            least, entry = distances[np.arange(len(rows)), place], members[place]
            better = (least < best[rows]) | ((least == best[rows]) & (entry < chosen[rows]))
            chosen[rows] = np.where(better, entry, chosen[rows])
            best[rows] = np.where(better, least, best[rows])
        # Scanned groups get exact bounds, on all their entries but the one now assigned.
        for g, rows, distances in second:
            members = books.groups[g]
            own = chosen[rows][:, None] == members
            others = np.where(own, np.inf, root(distances))
            state.lower[open_[rows], p, g], state.lower_stamp[open_[rows], p, g] = down(others.min(axis=1)), stamp
        # Where the entry changed, the old entry's group gets its distance as a further bound, if it was not scanned itself.
        changed = np.flatnonzero(chosen != was)
        for g, members in enumerate(books.groups):
            left = changed[np.isin(was[changed], members)]
            scanned = next((rows for k, rows, _ in second if k == g), np.zeros(0, np.int64))
            left = left[~np.isin(left, scanned)]
            if len(left):
                at = open_[left]
                # ``lower`` is carried to this round already, so it takes this round's stamp.
                state.lower[at, p, g] = np.minimum(lower[at, g], down(near[left] / (1 + 1e-6) * (1 - 1e-6)))
                state.lower_stamp[at, p, g] = stamp
        state.code[open_, p] = chosen
        state.upper[open_, p] = up(root(best))


PACKED = "code binary, upper binary, upper_stamp binary, lower binary, lower_stamp binary"
ROW = pa.schema([(c, pa.binary()) for c in ("code", "upper", "upper_stamp", "lower", "lower_stamp")])


def read_parts(values: pa.Array, plan: dict) -> np.ndarray:
    rows = whole_numbers(values, plan["width"], plan["scale"], plan["exact"])
    return rows.reshape(len(rows), plan["parts"], -1) if plan["width"] else np.zeros((len(rows), plan["parts"], 0), rows.dtype)


def round_pass(rows: DataFrame, books: list[np.ndarray], plan: dict, last: bool) -> DataFrame:
    """Rows with codes of the newest codebook and their bounds; the last round gives the error instead of bounds."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()
    first, parts = "code" not in rows.columns, plan["parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codebooks(sent.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                x = read_parts(batch.column(2), plan)
                state = Assigned.unknown(len(x), parts) if first else Assigned.unpack(batch.columns[3:], len(x), parts)
                assign(x, known, state)
                if last:
                    chosen = known.now[np.arange(parts), state.code.astype(np.int64)]
                    error = square_sum(x - chosen).sum(axis=1)
                    codes = pa.array([row.tobytes().hex() for row in state.code], pa.string())
                    errors = pa.array([min(int(e), MOST) for e in error], pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], codes, errors], names=["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], *state.pack()], names=["vec_id", "label", "x", *ROW.names])

    kept = f"vec_id long, label {label}"
    return rows.mapInArrow(run, f"{kept}, code string, error long" if last else f"{kept}, x array<double>, {PACKED}")


def entry_sums(rows: DataFrame, plan: dict) -> list:
    """(part, entry, n, limbs): how many parts each entry has and the sums of their components, in limbs of 40 bits."""
    limbs, parts, entries = plan["limbs"], plan["parts"], plan["entries"]
    length = plan["width"] // parts * limbs
    columns = ", ".join(["part int", "entry int", "n long", *(f"s{k} long" for k in range(length))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, plan["width"] // parts), object if plan["exact"] else np.int64)
        for batch in batches:
            x = read_parts(batch.column(0), plan)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        p, e = np.nonzero(n)
        found, out = total[p, e], []
        for k in range(limbs):  # the last limb holds the sign
            out.append(found if k + 1 == limbs else found & ((1 << LIMB_BITS) - 1))
            found = found >> LIMB_BITS
        sums = np.stack(out, axis=-1).reshape(len(p), length).astype(np.int64)
        arrays = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(c) for c in sums.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in columns.split(", ")])

    sums = rows.select("x", "code").mapInArrow(run, columns)
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(length))).collect()


def moved_books(book: np.ndarray, sums: list, plan: dict) -> np.ndarray:
    """The next codebook: floors of means; entries without parts stay."""
    out, limbs = book.copy(), plan["limbs"]
    for row in sums:
        values = list(row)[3:]
        for c in range(book.shape[2]):
            total = sum(v << (LIMB_BITS * k) for k, v in enumerate(values[c * limbs : (c + 1) * limbs]))
            out[row["part"], row["entry"], c] = total // row["n"]
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def quantise(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable row, written, and the codebooks of all rounds.

    ``code`` has two hex digits per part; at most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part")
    spark, rows = vectors.sparkSession, usable(vectors)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("far")).first()
    width = -(-(shape["width"] or 0) // parts) * parts
    far = int(shape["far"] or 0) * scale + 2 * scale
    plan = {"parts": parts, "width": width, "scale": scale, "entries": max(1, min(entries, shape["n"]))}
    # Differences are at most twice as large; sums of a task's rows, too, must stay whole.
    plan["exact"] = not (width // parts * 4 * far * far < EXACT and far < 1 << 40)
    plan["limbs"] = far.bit_length() // LIMB_BITS + 2
    smallest = rows.select(F.col("vec_id").isNull().alias("none"), "vec_id", "x").orderBy("none", "vec_id", "x").limit(entries).collect()
    start = read_parts(pa.array([r["x"] for r in smallest] or [[]], pa.list_(pa.float64())), plan)
    books = [np.ascontiguousarray(start.transpose(1, 0, 2))]
    written: list[str] = []
    for _ in range(rounds):
        written.append(scratch_path(spark, "codes"))
        state = round_pass(rows, books, plan, last=False)
        state.write.parquet(written[-1])
        rows = spark.read.schema(state.schema).parquet(written[-1])
        books.append(moved_books(books[-1], entry_sums(rows, plan), plan))
        for path in written[:-1]:
            remove(spark, path)
    written.append(scratch_path(spark, "codes"))
    final = round_pass(rows, books, plan, last=True)
    final.write.parquet(written[-1])
    if rounds:
        remove(spark, written[-2])
    return spark.read.schema(final.schema).parquet(written[-1]), books


def books_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in book.reshape(-1)).encode()).hexdigest()


@register(
    "op13_vector_codes",
    """
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
            row_number() OVER (ORDER BY vec_id) - 1 AS place
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), size AS (SELECT (max(len(v)) // 16)::INT AS w FROM kept),
    parts AS MATERIALIZED (
        SELECT place, vec_id, label, p::INT AS p, v[p * w + 1 : (p + 1) * w] AS part
        FROM kept, size, range(16) AS r(p)
    ), c0 AS MATERIALIZED (SELECT p, place::INT AS e, part AS entry FROM parts WHERE place < 64),
    a0 AS MATERIALIZED (
        SELECT place, s.p, any_value(part) AS part,
            min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS best
        FROM parts s JOIN c0 c ON s.p = c.p GROUP BY place, s.p
    ), m0 AS (
        SELECT p, (best % 64)::INT AS e, i, floor(sum(part[i + 1])::DOUBLE / count(*))::BIGINT AS x
        FROM a0, size, range(w) AS r(i) GROUP BY p, e, i
    ), n0 AS (SELECT p, e, list(x ORDER BY i) AS entry FROM m0 GROUP BY p, e),
    c1 AS MATERIALIZED (SELECT c0.p, c0.e, coalesce(n0.entry, c0.entry) AS entry FROM c0 LEFT JOIN n0 ON c0.p = n0.p AND c0.e = n0.e),
    a1 AS MATERIALIZED (
        SELECT place, s.p, any_value(part) AS part,
            min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS best
        FROM parts s JOIN c1 c ON s.p = c.p GROUP BY place, s.p
    ), m1 AS (
        SELECT p, (best % 64)::INT AS e, i, floor(sum(part[i + 1])::DOUBLE / count(*))::BIGINT AS x
        FROM a1, size, range(w) AS r(i) GROUP BY p, e, i
    ), n1 AS (SELECT p, e, list(x ORDER BY i) AS entry FROM m1 GROUP BY p, e),
    c2 AS MATERIALIZED (SELECT c1.p, c1.e, coalesce(n1.entry, c1.entry) AS entry FROM c1 LEFT JOIN n1 ON c1.p = n1.p AND c1.e = n1.e),
    a2 AS (
        SELECT place, s.p, any_value(vec_id) AS vec_id, any_value(label) AS label,
            min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS best
        FROM parts s JOIN c2 c ON s.p = c.p GROUP BY place, s.p
    ), coded AS (
        SELECT any_value(vec_id) AS vec_id, any_value(label) AS label,
            string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
        FROM a2 GROUP BY place
    ), books AS (
        SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
        FROM (SELECT p, e, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM c2)
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
    """,
)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's code and error, its label's error, and a digest of the final codebooks."""
    coded, books = quantise(read_table(spark, folder, "embeddings"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books[-1])).alias("codebooks_sha256")
    )
