"""Binary formats: compressed sparse rows (``_deg``, ``_adj``, ``_label`` files) and embedding dumps.

Little-endian. ``<p>_deg.bin``: int32 4, uint32 vertices, uint32 edges, uint32 degree of each vertex;
``<p>_adj.bin``: uint32 neighbours of all vertices, one after another; ``<p>_label.bin``: uint32 label
of each vertex. Embeddings: uint32 columns, uint64 rows, uint32 pattern vertex of each column, uint32
rows. These are single files of 32-bit numbers, exchanged with tools on one machine; graphs at scale
are kept as Parquet (``PropertyGraph.save``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph


def read_csr(spark: SparkSession, degree_path: str, adjacency_path: str, label_path: str | None = None) -> PropertyGraph:
    """A graph of the three files; labels are 0 without the third."""
    head = np.fromfile(degree_path, dtype="<u4")
    if len(head) < 3 or head[0] != 4 or len(head) != head[1] + 3:
        raise ValueError(f"{degree_path} isn't a degree file of 4-byte numbers")
    degree = head[3:].astype(np.int64)
    near = np.fromfile(adjacency_path, dtype="<u4").astype(np.int64)
    if len(near) != degree.sum():
        raise ValueError("degrees and neighbours don't match")
    label = np.fromfile(label_path, dtype="<u4").astype(np.int32) if label_path else np.zeros(len(degree), np.int32)
    v = pa.table({"vid": np.arange(len(degree), dtype=np.int64), "label": label})
    e = pa.table({"src": np.repeat(np.arange(len(degree), dtype=np.int64), degree), "dst": near})
    return PropertyGraph.of(spark.createDataFrame(v), spark.createDataFrame(e))


def write_csr(graph: PropertyGraph, prefix: str) -> None:
    """The three files; vertices must be numbered from 0 without gaps, and fit the driver."""
    v = graph.vertices.toArrow()
    vid, label = v.column("vid").to_numpy(), v.column("label").to_numpy()
    order = np.argsort(vid)
    if not np.array_equal(vid[order], np.arange(len(vid))):
        raise ValueError("vertices must be numbered from 0 without gaps")
    e = graph.edges.select("src", "dst").toArrow()
    src, dst = e.column("src").to_numpy(), e.column("dst").to_numpy()
    by = np.lexsort((dst, src))
    degree = np.bincount(src.astype(np.int64), minlength=len(vid))
    np.concatenate([[4, len(vid), len(src) // 2], degree]).astype("<u4").tofile(f"{prefix}_deg.bin")
    dst[by].astype("<u4").tofile(f"{prefix}_adj.bin")
    label[order].astype("<u4").tofile(f"{prefix}_label.bin")


#: Rows that an embedding dump holds at most; fixed by the format's tools.
MOST_ROWS = 1 << 20


def write_embeddings(matches: DataFrame, order: list[int], path: str, most: int | None = None) -> int:
    """Columns in the order's sequence; how many rows were written.

    With ``most``, that many rows at most; without it, more than ``MOST_ROWS`` are an error.
    """
    t = matches.select(*[f"u{u}" for u in order]).limit(MOST_ROWS + 1 if most is None else most).toArrow()
    if most is None and t.num_rows > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} embeddings; a dump holds no more unless they are cut by most=")
    rows = np.column_stack([t.column(i).to_numpy() for i in range(len(order))]) if t.num_rows else np.empty((0, len(order)))
    with open(path, "wb") as f:
        f.write(np.array([len(order)], "<u4").tobytes() + np.array([t.num_rows], "<u8").tobytes() + np.array(order, "<u4").tobytes())
        f.write(rows.astype("<u4").tobytes())
    return t.num_rows


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """u0, u1 and so on of an embedding dump."""
    with open(path, "rb") as f:
        raw = f.read()
    n, count = int(np.frombuffer(raw, "<u4", 1)[0]), int(np.frombuffer(raw, "<u8", 1, 4)[0])
    order = np.frombuffer(raw, "<u4", n, 12).tolist()
    rows = np.frombuffer(raw, "<u4", n * count, 12 + 4 * n).reshape(count, n).astype(np.int64)
    table = pa.table({f"u{u}": rows[:, i] for i, u in enumerate(order)})
    return spark.createDataFrame(table).select(*[F.col(f"u{u}") for u in sorted(order)])
