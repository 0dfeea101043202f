"""Fill-in-middle transformation by secondary-sort assembly (operator 11).

A text is cut into units (a word with the white space before it; white space at
the end is a unit of its own).  Numbers from a digest of seed and id choose two
places between units, and whether and how the three sections change places:

* ``plain``: the text as it is;
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

The task that reads a text emits its sections as *pieces* of at most ``units``
units, keyed by (row, place in the output).  One secondary sort
(``repartitionAndSortWithinPartitions`` by row) puts the pieces of each output in
order, and they stream into its digest piece by piece: neither an output nor a
document's pieces are gathered.  Restoration reads that stream back: the markers
in it say which section follows, its pieces are keyed by their place in the
source and sorted again.  That second sort has the first one's partitioner, so
nothing is shuffled twice.  Sorting spills to disk, and a lost executor's
partitions are made again from the shuffle.

Rows are keyed by their number, not by their id, so a third of all rows with one
id spread like any others.  Partitions follow the bytes of text
(``partition_bytes`` each).

Null text counts as empty; an empty text has no units and is plain.  A null id
counts as the empty string in the digest.  A text that holds a marker is plain,
so an output can always be read back.  Repeated rows are transformed each; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .words import split_words

#: fixed values: the markers before prefix, suffix and middle
MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: sections in the order of each form's output
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ("prefix",)}
#: sections in the order of the source
SOURCE = {"prefix": 0, "middle": 1, "suffix": 2}
_SECTION = {mark: name for name, mark in MARKERS.items()}

UNITS = 4096
PARTITION_BYTES = 32 << 20
#: section number times this, plus the piece's number in its section, is a place
_PLACES = 1 << 40


@dataclass(frozen=True)
class Rates:
    """In percent: outputs that are transformed, and those of them that are spm."""
    transformed: int = 50
    spm: int = 80
    seed: int = 42


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of each row: groups of the digest of seed and id."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_ends(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text ends in them, ends of all units,
    where the units of each text begin) of an Arrow column of texts."""
    w = split_words(column)
    stop = w.offsets[1:]
    counts = w.counts
    last = np.where(counts > 0, w.ends[np.maximum(w.first[1:] - 1, 0)] if len(w.ends) else 0, w.offsets[:-1])
    tail = stop > last                        # white space at the end
    ends = np.insert(w.ends, w.first[1:][tail], stop[tail])
    return w.buf, w.offsets, ends, np.concatenate([[0], np.cumsum(counts + tail)])


def _sections(buf: np.ndarray, begin: int, ends: np.ndarray, cuts: list[int], form: str, units: int):
    """(section number, piece number, bytes) of one text's output; ``ends``
    are its units' ends."""
    bounds = {"prefix": (0, cuts[0]), "middle": (cuts[0], cuts[1]), "suffix": (cuts[1], len(ends))}
    if form == "plain":
        bounds["prefix"] = (0, len(ends))
    for number, name in enumerate(ORDERS[form]):
        a, b = bounds[name]
        mark = MARKERS[name] if form != "plain" else b""
        for k, first in enumerate(range(a, max(b, a + 1), units)):
            last = min(first + units, b)
            lo = begin if first == 0 else ends[first - 1]
            hi = begin if last == 0 else ends[last - 1]
            yield number, k, (mark if k == 0 else b"") + buf[lo:hi].tobytes()


_PIECES = "row long, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, data binary"


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, rates: Rates, units: int) -> DataFrame:
    """One row per piece of every output, keyed by row and place; the first
    piece of a row carries what is known of the document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = F.lit(False)
    for mark in MARKERS.values():
        marked = marked | F.contains(text, F.lit(mark.decode()))
    h = draws(F.col(f"`{id_col}`"), rates.seed)
    form = F.when((text == "") | marked | (h[2] % 100 >= rates.transformed), "plain") \
        .when(h[3] % 100 < rates.spm, "spm").otherwise("psm")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       h[0].alias("h1"), h[1].alias("h2"), form.alias("form"), text.alias("text"))
    schema = docs.sparkSession.createDataFrame([], _PIECES).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offsets, ends, first = unit_ends(part.column("text"))
                n = np.diff(first)
                places = np.stack([part.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")])
                places.sort(axis=0)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                out: list[list] = [[] for _ in arrow]
                ids, forms = part.column("doc_id").to_pylist(), part.column("form").to_pylist()
                for d, row in enumerate(part.column("row").to_pylist()):
                    own, begin, cuts = ends[first[d]:first[d + 1]], int(offsets[d]), places[:, d].tolist()
                    at = [chars[begin if c == 0 else own[c - 1]] for c in (0, *cuts)]
                    known = [None, None] if forms[d] == "plain" else [int(at[1] - at[0]), int(at[2] - at[1])]
                    for number, k, data in _sections(buf, begin, own, cuts, forms[d], units):
                        for column, value in zip(out, (row, number * _PLACES + k, ids[d], int(n[d]), forms[d], *known, data)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
    return rows.mapInArrow(run, schema)


def _by_row(records):
    """(row, its records in order) of sorted ((row, place), value) records."""
    return groupby(records, key=lambda r: r[0][0])


def _assemble(records):
    """Stream each output into its digest and pass its pieces on, keyed by their
    place in the source; the markers in the stream tell the sections apart."""
    for row, pieces in _by_row(records):
        digest, number, k, known = hashlib.sha256(), SOURCE["prefix"], 0, None
        for (_, _), (data, own) in pieces:
            digest.update(data)
            known = known or own
            name = _SECTION.get(data[:3]) if own[2] != "plain" else None
            if name is not None:
                number, k, data = SOURCE[name], 0, data[3:]
            yield (row, number * _PLACES + k), (data, None)
            k += 1
        yield (row, -1), (digest.hexdigest(), known)


def _restore(records):
    """Stream each restored text into its digest."""
    for _, pieces in _by_row(records):
        digest = hashlib.sha256()
        _, (output, known) = next(pieces)
        for _, (data, _) in pieces:
            digest.update(data)
        yield (*known, output, digest.hexdigest())


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _partitions(docs: DataFrame, text_col: str, partition_bytes: int) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))


def _sorted_pieces(docs: DataFrame, id_col: str, text_col: str, rates: Rates, units: int, partition_bytes: int):
    parts = _partitions(docs, text_col, partition_bytes)
    pieces = cut_pieces(docs, id_col, text_col, rates, units).rdd \
        .map(lambda p: ((p[0], p[1]), (bytes(p[7]), tuple(p[2:7]))))
    return pieces.repartitionAndSortWithinPartitions(parts, _row_of), parts


def _row_of(key) -> int:
    return hash(key[0])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates(),
            units: int = UNITS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per document: units, form, code points of prefix and middle (null
    if plain), digest of the output, and digest of the text restored from it."""
    pieces, parts = _sorted_pieces(docs, id_col, text_col, rates, units, partition_bytes)
    restored = pieces.mapPartitions(_assemble, preservesPartitioning=True) \
        .repartitionAndSortWithinPartitions(parts, _row_of).mapPartitions(_restore)
    return docs.sparkSession.createDataFrame(restored, _RESULT, verifySchema=False)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates(),
              units: int = UNITS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, form, output): the transformed texts themselves."""
    def join(records):
        for _, group in _by_row(records):
            values = list(map(itemgetter(1), group))       # the pieces of one text
            yield values[0][1][0], values[0][1][2], b"".join(v[0] for v in values).decode()
    pieces, _ = _sorted_pieces(docs, id_col, text_col, rates, units, partition_bytes)
    return docs.sparkSession.createDataFrame(pieces.mapPartitions(join), "doc_id long, form string, output string",
                                             verifySchema=False)


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output", text_col: str = "text") -> DataFrame:
    """``outputs`` with the source text of each; needs no other row."""
    out, form = F.col(f"`{output_col}`"), F.col(f"`{form_col}`")
    parts = F.split(out, "<[PSM]>", 4)                      # '' and the three sections, in the form's order
    joined = F.when(form == "plain", out) \
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2])) \
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return outputs.withColumn(text_col, joined)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole document, half of them transformed, four of five of these spm."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)
