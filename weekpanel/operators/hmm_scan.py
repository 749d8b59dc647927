"""Filter, smoother and best path over sequences of any length, as an associative scan.

A sequence is cut into chunks by a bucket of its order column, so no task holds one whole. Each chunk gives two transfer
matrices (states x states): in the log semiring for the probabilities, in the max-plus one for the path. Runs of ``FAN``
matrices are multiplied level by level until a sequence is one matrix; on the way down every member of a run learns what
enters it (forward vector, state before it) and what leaves it (backward vector, state at its end). Then all chunks are
finished independently. A very long sequence is many chunks in many tasks; only matrices are grouped by sequence, ``FAN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions import arrow_rows, hmm_kernels, scan_kernels
from weekpanel.session import cut_lineage

cloudpickle.register_pickle_by_value(arrow_rows)
cloudpickle.register_pickle_by_value(hmm_kernels)
cloudpickle.register_pickle_by_value(scan_kernels)

FAN = 64


def cut(rows: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], bucket: Column) -> DataFrame:
    """One row per chunk: sequence (text of its keys), keys, idx (gapless from 0), n (chunks of the sequence), t and x.

    ``bucket`` is a whole number that never falls along ``order``; the rows of one bucket are one chunk. Rows with a missing
    feature are left out."""
    vector = F.array(*[F.col(c).cast("double") for c in features])
    kept = rows.dropna("any", subset=list(features)).select(
        F.to_json(F.struct(*keys)).alias("sequence"), F.struct(*keys).alias("keys"), bucket.cast("long").alias("chunk"),
        F.struct(F.col(order).alias("t"), vector.alias("x")).alias("p"))
    chunks = kept.groupBy("sequence", "keys", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    chunks = cut_lineage(chunks.select("sequence", "keys", "chunk", F.transform("p", lambda r: r["t"]).alias("t"), F.transform("p", lambda r: r["x"]).alias("x")))
    # numbers of the chunks: one small row per chunk goes through the window, not its values
    of = Window.partitionBy("sequence")
    places = chunks.select("sequence", "chunk").select(
        "sequence", "chunk", (F.row_number().over(of.orderBy("chunk")) - 1).cast("long").alias("idx"), F.count("*").over(of).alias("n"))
    return cut_lineage(chunks.join(places, ["sequence", "chunk"]).drop("chunk"))


def infer_long(rows: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], params: dict, bucket: Column, fan: int = FAN) -> DataFrame:
    """keys, ``order``, filtered, smoothed (arrays of probabilities) and viterbi for every complete row."""
    start, trans, means, covars = (np.asarray(params[c], float) for c in ("start", "trans", "means", "covars"))
    k, hk, sk, held = len(start), hmm_kernels, scan_kernels, arrow_rows
    log_start, log_a = sk.log(start), sk.log(trans)
    chunks = cut(rows, keys, order, features, bucket)

    def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Bounded groups of chunks: their rows, log densities and lengths."""
        for part in held.runs(held.lengths_of(batch.column("x")), hk.CHUNK, hk.STEPS):
            own = batch.slice(part.start, part.stop - part.start)
            vectors, lengths = held.vectors(own.column("x"))
            yield own, hk.log_emissions(held.padded(vectors, lengths), means, covars), lengths

    def numbers(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, log_b, lengths in parts_of(batch):
                total, best = sk.transfers(log_b, lengths, numbers(own.column("idx")) == 0, log_start, log_a)
                flat = [held.arrays(m.reshape(len(m), -1)) for m in (total, best)]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("sequence", "idx", "n")], *flat], ["sequence", "idx", "n", "total", "best"])

    kind = "sequence string, idx long, n long, total array<double>, best array<double>"
    level = cut_lineage(chunks.select("sequence", "idx", "n", "x").mapInArrow(matrices, kind))
    runs = []  # one row per run of at most ``fan`` members, level by level

    def members_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """idx, total and best of the members of all runs below each other, and where each run begins (and the last ends)."""
        column = batch.column("members")
        idx, total, best = column.flatten().flatten()
        square = lambda m: numbers(m.flatten()).reshape(-1, k, k)
        return numbers(idx), square(total), square(best), np.append(0, np.cumsum(held.lengths_of(column)))

    while True:
        member = F.struct("idx", "total", "best")
        grouped = cut_lineage(level.groupBy("sequence", F.floor(F.col("idx") / fan).alias("run"), F.ceil(F.col("n") / fan).alias("runs")).agg(
            F.sort_array(F.collect_list(member)).alias("members")))
        runs.append(grouped)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, total, best, ends = members_of(batch)
                    made = [sk.product(total[i:j], best[i:j]) for i, j in zip(ends, ends[1:])]
                    flat = [held.arrays(np.stack([m[i].ravel() for m in made])) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("sequence", "run", "runs")], *flat], ["sequence", "idx", "n", "total", "best"])

        level = cut_lineage(grouped.mapInArrow(multiply, kind))
        if not level.where("n > 1").limit(1).count():
            break

    seen = "sequence string, idx long, alpha array<double>, beta array<double>, s_in int, s_out int"
    names = ["sequence", "idx", "alpha", "beta", "s_in", "s_out"]

    def known_rows(sequence: pa.Array, idx, alpha: np.ndarray, beta: np.ndarray, s_in, s_out) -> pa.RecordBatch:
        states = [pa.array(np.asarray(s, np.int32)) for s in (s_in, s_out)]
        return pa.RecordBatch.from_arrays([sequence, idx if isinstance(idx, pa.Array) else pa.array(idx), held.arrays(alpha), held.arrays(beta), *states], names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the first chunk holds the start in every row, so any state may stand before it
            if batch.num_rows:
                best, none = numbers(batch.column("best").flatten()).reshape(-1, k * k), np.zeros((batch.num_rows, k))
                yield known_rows(batch.column("sequence"), batch.column("idx"), none, none, none[:, 0], best[:, :k].argmax(1))

    known = level.mapInArrow(ends, seen)

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, total, best, begins = members_of(batch)
            alpha, beta = (numbers(batch.column(c).flatten()).reshape(-1, k) for c in ("alpha", "beta"))
            s_in, s_out = (numbers(batch.column(c)) for c in ("s_in", "s_out"))
            made = [sk.spread(total[i:j], best[i:j], alpha[r], beta[r], s_in[r], s_out[r]) for r, (i, j) in enumerate(zip(begins, begins[1:]))]
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(begins)))
            yield known_rows(batch.column("sequence").take(of), idx, *[np.concatenate([m[i] for m in made]) for i in range(4)])

    for grouped in reversed(runs):
        # the sequences that were one matrix before the last level pass through the upper levels as runs of one
        known = cut_lineage(grouped.withColumnRenamed("run", "idx").drop("runs").join(known, ["sequence", "idx"]).drop("idx").mapInArrow(hand_down, seen))

    time_type = dict(rows.dtypes)[order]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, log_b, lengths in parts_of(batch):
                alpha, beta = (numbers(own.column(c).flatten()).reshape(-1, k) for c in ("alpha", "beta"))
                filtered, smoothed, path = sk.finish(
                    log_b, lengths, numbers(own.column("idx")) == 0, log_start, log_a, alpha, beta, numbers(own.column("s_in")), numbers(own.column("s_out")))
                each = [held.lists(held.arrays(held.cut(a, lengths)), lengths) for a in (filtered, smoothed)]
                yield pa.RecordBatch.from_arrays(
                    [own.column("sequence"), own.column("idx"), *each, held.lists(held.cut(path, lengths).astype(np.int32), lengths)],
                    ["sequence", "idx", "filtered", "smoothed", "viterbi"])

    done = chunks.select("sequence", "idx", "x").join(known, ["sequence", "idx"]).mapInArrow(
        finish, "sequence string, idx long, filtered array<array<double>>, smoothed array<array<double>>, viterbi array<int>")
    zipped = F.arrays_zip("t", "filtered", "smoothed", "viterbi")
    out = chunks.select("sequence", "idx", "keys", "t").join(done, ["sequence", "idx"]).select("keys.*", F.inline(zipped))
    return out.withColumn("t", F.col("t").cast(time_type)).withColumnRenamed("t", order)
