"""Removal of repeated passages of lines: overlapping windows of three lines, found everywhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import IS_WORD, U64, map_slices, mix, signed, stored, text_arrays
from galewise.llm.suffix_dedup import numbered


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(h1, h2, doc, line): a 128-bit key of each window of ``size`` lines that aren't all blank, chained from digests of its lines."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = text_arrays(part.column("text"))
        doc, made = part.column("doc").to_numpy(zero_copy_only=False), []
        for i in range(part.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            breaks = np.flatnonzero(own == 10)
            count = len(breaks) + 2 - size
            if count <= 0:
                continue
            starts = np.concatenate(([0], breaks + 1))[:count]
            ends = np.concatenate((breaks, [len(own)]))[size - 1 :]
            marks = np.concatenate(([0], np.cumsum(IS_WORD[own])))
            full = np.flatnonzero(marks[ends] > marks[starts])
            lines = own.tobytes().split(b"\n")
            halves = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines), dtype=U64).reshape(-1, 2)
            keys = np.zeros((len(full), 2), dtype=U64)
            for k in range(size):
                keys = mix(mix(keys) ^ halves[full + k])
            made.append((keys, np.full(len(full), doc[i]), full))
        if not made:
            return None
        keys, who, line = (np.concatenate(x) for x in zip(*made))
        return pa.RecordBatch.from_arrays([signed(keys[:, 0]), signed(keys[:, 1]), pa.array(who), pa.array(line.astype(np.int32))], names=["h1", "h2", "doc", "line"])

    return map_slices(docs.select("doc", "text"), "text", "h1 long, h2 long, doc long, line int", work)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, text, the lines that remain joined again, and the columns ``carry``.

    Lines are what newlines separate. A window of ``size`` lines that occurs again, in a larger id or further down in the same
    text, is a repeat; all lines that such repeats cover go, overlaps once. Windows are judged on the input, so the
    first occurrence always stays. Repeats grow with the texts, so they are joined by sorting, never broadcast. Windows of blank lines alone don't count, and a text of fewer lines has none.

    A null text stays null, with 0 lines; an empty text has one. If all lines go, the text is empty. Rows equal in id and text count as one
    document; rows that share an id alone are taken in the order of a hash of their texts, null ids last. Extra columns are ignored.
    """
    kept_columns = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows, single = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept_columns))
    windows = stored(_windows(single, size), "windows")
    place = F.min(F.struct("doc", "line")).alias("first")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), place).where("n > 1")
    again = stored(again.select("h1", "h2", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line")), "again")
    repeats = windows.join(again.hint("merge"), ["h1", "h2"]).where("doc <> first_doc or line <> first_line")
    lists = stored(repeats.groupBy("doc").agg(F.collect_list("line").alias("lines")), "repeats")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = part.column("text").cast(pa.binary()).to_pylist(), part.column("lines").to_pylist()
        count, removed, kept = [], [], []
        for text, lines in zip(texts, lists):
            total = 0 if text is None else text.count(b"\n") + 1
            gone = 0
            if lines:
                stay = np.ones(total, dtype=bool)
                for k in range(size):
                    stay[np.array(lines) + k] = False
                own = text.split(b"\n")
                text, gone = b"\n".join([own[j] for j in np.flatnonzero(stay)]), int(total - stay.sum())
            count.append(total), removed.append(gone), kept.append(text)
        columns = [pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        names = [f"carried_{i}" for i in range(len(carry))]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *columns, *(part.column(c) for c in names)], names=["doc_id", "n_lines", "n_removed", "text", *names]
        )

    names = [f"carried_{i}" for i in range(len(carry))]
    schema = "doc_id long, n_lines long, n_removed long, text string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in names)
    out = map_slices(rows.join(lists.hint("merge"), "doc", "left").select("doc_id", "text", "lines", *names), "text", schema, work)
    return out.withColumnsRenamed(dict(zip(names, carry)))
