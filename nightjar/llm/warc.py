"""Operator 4: WARC archives, and a capture index by external merge.

*Writing.*  Every row becomes a WARC/1.1 record.  Of records with equal
payloads of ``min_bytes`` or more, the one with the largest id is a response
and the others are revisits of it; all smaller ones are responses.  Records
are written by Spark's text writer with the record separator as line end, so
a lost task is written again and commits once; archives are gzip files of at
most ``RECORDS`` records below the shared folder.

*Reading.*  Spark's text source unpacks an archive as a stream, cut where the
separator occurs; the pieces are put together again by content length, as
payloads may hold separators themselves.  A task holds one record, not an
archive, so an archive may be of any size.

*Index.*  An archive's captures, sorted by URL key, time and id, are a run.
Runs are dealt by ranges of that order, so that each task merges the pieces of
all runs that fall into its range, with a loser tree; ranges follow one
another, hence the whole is ordered.  A URL with very many captures spreads
over ranges by time.  A merge holds its range as it came over the network
(index entries, no payloads) and a batch of each run as rows.

Cases: a null payload is empty; a null url gives a record without a target
and an empty URL key; control characters in a url are percent-encoded; null
ids count as smaller than all others; of rows that repeat the largest id with
one payload each is a response; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import emit, materialise, work_folder

#: Records of one archive.
RECORDS = 2000
#: Index entries of a run that a merge has as rows, and entries it emits at once.
MERGE_BATCH = 2048
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            date_col: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """(record) strings of every row, without the separator at the end."""
    date = F.col(date_col) if date_col else F.timestamp_seconds(F.lit(1704067200))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
                        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.encode("payload", "UTF-8"))})
    # the id that others revisit, for payloads that occur more than once
    shared = materialise(rows.where(f"bytes >= {min_bytes}").groupBy("digest", "bytes")
                         .agg(F.max("id").alias("first"), F.count("*").alias("n"))
                         .where("n > 1 and first is not null").select("digest", "bytes", "first"), "payloads",
                         narrow=True)
    rows = rows.join(shared, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    safe = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    safe = F.regexp_replace(safe, "[\\x00-\\x1f\\x7f]", "%20")

    def header(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def uri(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", uri("id")), header("WARC-Date", F.col("date")),
        F.when(F.col("url") != "", header("WARC-Target-URI", safe)).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(header("WARC-Refers-To", uri("first")), header("WARC-Profile", F.lit(_PROFILE))))
        .otherwise(""),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body).alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    (records(pages, **options).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS).text(path))


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    host, _, rest = url.partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))})/{rest}" if host else ""


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip bytes (one or more members), a stretch at a time."""
    at, unzip = 0, zlib.decompressobj(31)
    while at < len(data):
        part = unzip.decompress(data[at:at + _CHUNK])
        at += min(_CHUNK, len(data) - at)
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)
        if part:
            yield part


class _Stream:
    """Reads from stretches of bytes by length or up to a mark."""

    def __init__(self, stretches: Iterator[bytes]):
        self.stretches, self.buffer, self.offset = stretches, b"", 0

    def _more(self) -> bool:
        part = next(self.stretches, None)
        if part is None:
            return False
        self.buffer += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("archive ends inside a record")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        self.offset += n
        return whole[:n]


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    return out


_URN = re.compile(r"<urn:page:(-?\d+)>")


def parse_archive(stretches: Iterator[bytes]) -> Iterator[dict]:
    """Captures of one archive in file order, payload digests recomputed."""
    source = _Stream(stretches)
    while True:
        offset = source.offset
        head = source.until(b"\r\n\r\n")
        if head == END.encode() and source.until(b"WARC/") is None:
            return  # the text source may add an empty piece at the end of a file
        if head is None:
            return
        h = _headers(head)
        body = source.take(int(h["content-length"]))
        source.take(len(END))
        http, _, payload = body.partition(b"\r\n\r\n")
        size = int(_headers(http)["content-length"])
        stated = h["warc-payload-digest"].removeprefix("sha1:")
        whole = h["warc-type"] == "response"
        if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
            raise ValueError(f"payload of {h['warc-record-id']} does not match its record")
        own, other = _URN.fullmatch(h["warc-record-id"]), _URN.fullmatch(h.get("warc-refers-to", ""))
        yield {"urlkey": url_key(h.get("warc-target-uri", "")), "captured": h["warc-date"],
               "page_id": int(own[1]) if own else None, "record_type": h["warc-type"],
               "payload_bytes": size, "payload_digest": stated, "refers_to": int(other[1]) if other else None,
               "offset": offset, "length": source.offset - offset}


_INDEX = {"urlkey": pa.string(), "captured": pa.string(), "page_id": pa.int64(), "record_type": pa.string(),
          "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "offset": pa.int64(),
          "length": pa.int64(), "run": pa.string()}
_SCHEMA = ("urlkey string, captured string, page_id long, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, offset long, length long, run string")


def _order(c: dict) -> tuple:
    return c["urlkey"], c["captured"], c["page_id"] is not None, c["page_id"] or 0, c["run"], c["offset"]


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(path, contents) of the archives that a task reads one after another."""
    pieces = (row for batch in batches for row in zip(batch.column("path").to_pylist(), batch.column("piece"),
                                                      strict=True))
    for path, own in itertools.groupby(pieces, key=lambda row: row[0]):
        yield path, (piece.as_buffer().to_pybytes() + END.encode() for _, piece in own)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, sorted within their archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, stretches in _archives(batches):
            rows = [c | {"run": name} for c in parse_archive(stretches)]
            rows.sort(key=_order)
            yield emit({k: [r[k] for r in rows] for k in _INDEX}, _INDEX)

    # gzip is not split: a task reads whole files, each from its beginning
    pieces = (spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
              .select(F.col("_metadata.file_path").alias("path"), F.encode("value", "UTF-8").alias("piece")))
    return pieces.mapInArrow(run, _SCHEMA)


class LoserTree:
    """K-way merge of sorted iterators: the inner nodes hold the losers of
    their matches, so replacing the winner replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _run_pieces(rows: pa.Table, size: int | None = None) -> list[Iterator[tuple]]:
    """One iterator per run of rows sorted by run: each turns a batch of its
    piece into tuples at a time."""
    if not len(rows):
        return []
    codes = rows.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(rows)].tolist()

    def piece(a: int, b: int) -> Iterator[tuple]:
        for start in range(a, b, size or MERGE_BATCH):
            part = rows.slice(start, min(size or MERGE_BATCH, b - start))
            names = [part.column(c).to_pylist() for c in ("urlkey", "captured", "page_id", "run", "offset")]
            for i, (key, date, page, name, offset) in enumerate(zip(*names, strict=True), start):
                yield key, date, page is not None, page or 0, name, offset, i
    return [piece(a, b) for a, b in zip(edges, edges[1:])]


def merged(captures: DataFrame) -> DataFrame:
    """The captures in the global order of (URL key, time, id); the result's
    partitions are consecutive ranges, and ``at`` numbers a task's rows."""
    dealt = (captures.repartitionByRange(F.col("urlkey"), F.col("captured"), F.col("page_id").asc_nulls_first(), "run",
                                         "offset")
             .sortWithinPartitions("run", "urlkey", "captured", F.col("page_id").asc_nulls_first(), "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema(list(_INDEX.items()))).combine_chunks()
        winners = iter(LoserTree(_run_pieces(rows)))
        while chosen := list(itertools.islice(winners, MERGE_BATCH)):
            yield from rows.take(pa.array([c[-1] for c in chosen], type=pa.int64())).to_batches()

    return dealt.mapInArrow(run, _SCHEMA)


def capture_index(pages: DataFrame, **options) -> DataFrame:
    """Write the rows as archives, read them back, merge their index."""
    spark = pages.sparkSession
    path = work_folder(spark, "warc")
    write_archives(pages, path, **options)
    return merged(materialise(runs(spark, path), "capture-runs"))
