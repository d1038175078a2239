"""Spectral libraries in SQLite files, as a data source.

A library holds a row a spectrum (``RefSpectra``) and its peaks as two packed arrays
(``RefSpectraPeaks``): m/z as 64-bit and intensities as 32-bit floats, either deflated
or plain. The source cuts the file into ranges of spectrum ids, one a task, and gives
peaks as Arrow batches that numpy decodes.

The file may lie wherever Spark reaches: ``addFile`` fetches it by Hadoop's file
systems, once for each executor. SQLite needs a file of its own there.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantloom.operators.ordering import numbered
from quantloom.scratch import Scratch

PEAKS = "id long, key string, mz double, intensity double, feature string, charge int, rt double"
_NAMES = [c.split()[0] for c in PEAKS.split(", ")]
BATCH = 1 << 16


def packed(blob: bytes | None, kind: str) -> np.ndarray:
    """Values of a packed array, deflated or plain."""
    data = blob or b""
    try:
        data = zlib.decompress(data)
    except zlib.error:
        pass
    return np.frombuffer(data[: len(data) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype(float)


def peaks_of(mz: bytes | None, intensity: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """m/z and intensities relative to the largest; None if their numbers differ."""
    x, y = packed(mz, "<f8"), packed(intensity, "<f4")
    if len(x) != len(y):
        return None
    top = y.max(initial=0.0)
    return x, y / top if top > 0 else y


def _opened(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro&immutable=1", uri=True)


class IdRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.step = options["name"], int(options.get("spectrapertask", 20_000))

    def partitions(self) -> list[IdRange]:
        with _opened(self.name) as db:
            first, last = db.execute("SELECT coalesce(min(id), 0), coalesce(max(id), -1) FROM RefSpectra").fetchone()
        return [IdRange(lo, min(lo + self.step - 1, last)) for lo in range(first, last + 1, self.step)] or [IdRange(0, -1)]

    def read(self, part: IdRange) -> Iterator[pa.RecordBatch]:
        query = "SELECT r.id, coalesce(nullif(r.peptideModSeq, ''), r.peptideSeq), r.precursorCharge, nullif(r.retentionTime, 0), p.peakMZ, p.peakIntensity FROM RefSpectra r JOIN RefSpectraPeaks p ON p.RefSpectraID = r.id WHERE r.id BETWEEN ? AND ? ORDER BY r.id"
        with _opened(self.name) as db:
            held: list[tuple] = []
            rows = 0
            for number, feature, charge, rt, mz, intensity in db.execute(query, (part.first, part.last)):
                peaks = peaks_of(mz, intensity)
                if peaks is not None and len(peaks[0]):
                    held.append((number, feature, charge, rt, *peaks))
                    rows += len(peaks[0])
                if rows >= BATCH:
                    yield _batch(held)
                    held, rows = [], 0
            if held:
                yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    number, feature, charge, rt, mz, intensity = zip(*held)
    each = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in mz]))
    told = [pa.array(number, pa.int64()), pa.array([f"{f}_{z}" for f, z in zip(feature, charge)], pa.string()), pa.array(np.concatenate(mz)), pa.array(np.concatenate(intensity)), pa.array(feature, pa.string()), pa.array(charge, pa.int32()), pa.array(rt, pa.float64())]
    return pa.RecordBatch.from_arrays([c if i in (2, 3) else c.take(each) for i, c in enumerate(told)], _NAMES)


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spectral_library"

    def schema(self) -> str:
        return PEAKS

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options)


def read_library_sqlite(spark: SparkSession, path: str, spectra_per_task: int = 20_000) -> DataFrame:
    """(key, mz, intensity, feature, charge, rt) of a SQLite library at any path that Spark reaches.

    Of several spectra of one key the one with the smallest id counts; spectra without
    peaks, or with unequal numbers of m/z and intensities, are left out. Intensities
    are relative to the spectrum's largest. A retention time of 0 is none.
    """
    spark.sparkContext.addFile(path)
    spark.dataSource.register(LibrarySource)
    rows = spark.read.format("spectral_library").option("name", os.path.basename(path)).option("spectraPerTask", spectra_per_task).load()
    first = rows.groupBy("key").agg(F.min("id").alias("id"))
    return rows.join(first, ["key", "id"], "left_semi").drop("id")


SQLITE_TABLES = """
CREATE TABLE RefSpectra (id INTEGER PRIMARY KEY, peptideSeq TEXT, precursorMZ REAL, precursorCharge INTEGER, peptideModSeq TEXT, retentionTime REAL, numPeaks INTEGER);
CREATE TABLE RefSpectraPeaks (RefSpectraID INTEGER, peakMZ BLOB, peakIntensity BLOB);
"""


def _packed_rows(batches):
    """Spectra with their peaks (a list of m/z and intensity) as two packed arrays."""
    for batch in batches:
        p = batch.column("p")
        ends, peaks = p.offsets.to_numpy() - p.offsets[0].as_py(), p.flatten()
        mz, intensity = (peaks.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        parts = list(zip(ends[:-1], ends[1:]))
        blobs = [[zlib.compress(mz[a:b].astype("<f8").tobytes()) for a, b in parts], [intensity[a:b].astype("<f4").tobytes() for a, b in parts]]
        told = [batch.column(c) for c in ("id", "feature", "charge", "rt")]
        yield pa.RecordBatch.from_arrays([*told, pa.array(np.diff(ends), pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["id", "feature", "charge", "rt", "n", "mz", "intensity"])


def write_library_sqlite(library: DataFrame, path: str) -> None:
    """Write (feature, charge, rt, mz, intensity) as one SQLite library, ids by feature and charge.

    The format is one file, so one task writes it, row by row as it reads them; spectra are
    put together, numbered in order and packed by Spark before, so that this task sorts and
    holds nothing. ``path`` is in a folder that driver and executors share.
    """
    from quantloom.files import open_path

    spectra = library.groupBy("feature", "charge", "rt").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    scratch = Scratch(library.sparkSession, "spectra")
    ordered = numbered(spectra, "feature", "charge", "rt", name="id", scratch=scratch)
    kinds = {c: ordered.schema[c].dataType.simpleString() for c in ("feature", "charge", "rt")}
    ready = ordered.mapInArrow(_packed_rows, f"id long, feature {kinds['feature']}, charge {kinds['charge']}, rt {kinds['rt']}, n long, mz binary, intensity binary")

    def written(batches):
        fs, target = open_path(path)
        handle, local = tempfile.mkstemp(suffix=".sqlite")
        os.close(handle)
        n = 0
        with sqlite3.connect(local) as db:
            db.executescript(SQLITE_TABLES)
            for batch in batches:
                n += batch.num_rows
                number, feature, charge, rt, size, mz, intensity = (batch.column(c).to_pylist() for c in ("id", "feature", "charge", "rt", "n", "mz", "intensity"))
                db.executemany("INSERT INTO RefSpectra VALUES (?, ?, NULL, ?, ?, ?, ?)", zip(number, feature, charge, feature, rt, size))
                db.executemany("INSERT INTO RefSpectraPeaks VALUES (?, ?, ?)", zip(number, mz, intensity))
            db.execute("CREATE INDEX PeaksOfSpectrum ON RefSpectraPeaks (RefSpectraID)")  # else each range of ids reads the whole table
        db.close()
        with open(local, "rb") as source, fs.open_output_stream(target) as out:
            while block := source.read(8 << 20):
                out.write(block)
        os.remove(local)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    scratch.table(ready, "packed").coalesce(1).mapInArrow(written, "n long").collect()
    scratch.clean()
