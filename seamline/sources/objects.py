"""JSON objects in files of any layout, read in parts.

A file is cut at every closing brace, so Spark's reader splits it by bytes even if it is one line. Each part is gone through twice. First without knowing what came before: what it does to the open brackets, and whether it ends in
a string, for either beginning. These transitions are composed in the order of the parts. Then each part knows where it stands and cuts its objects; one that reaches over several parts is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.workspace import Workspace

#: A string, which ends with its line at the latest, or a bracket.
_MARK = re.compile(r'"(?:[^"\\\n]|\\.)*(?:"|\n|\\?\Z)|[{}\[\]]')
_REST = re.compile(r'(?:[^"\\\n]|\\.)*(?:"|\n)')  # of a string


class Walk:
    """Goes through text, chunk after chunk. stack: open brackets; closed: closing ones beyond those that were opened here."""

    def __init__(self, in_string: bool = False, stack: str = ""):
        self.in_string, self.stack, self.closed = in_string, stack, 0

    def marks(self, text: str) -> Iterator[tuple[int, str]]:
        """Places of brackets outside strings; the stack is changed after each."""
        at = 0
        if self.in_string:
            end = _REST.match(text)
            if not end:
                return
            self.in_string, at = False, end.end()
        for m in _MARK.finditer(text, at):
            c = m[0][0]
            if c == '"':
                self.in_string = m.end() == len(text) and (len(m[0]) == 1 or m[0][-1] not in '"\n')
                continue
            yield m.start(), c
            if c in "{[":
                self.stack += c
            elif self.stack:
                self.stack = self.stack[:-1]
            else:
                self.closed += 1


def _within(stack: str) -> bool:
    """Whether an object is open that is a row: at the top, or in a list at the top."""
    return stack.startswith(("{", "[{"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, list]]:
    """Part (path, start), its next stretch of text with the closing braces put back, and the other columns of its first row."""
    for batch in batches:
        paths, starts, pieces = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lo = 0
        for hi in range(1, len(paths) + 1):
            if hi == len(paths) or (paths[hi], starts[hi]) != (paths[lo], starts[lo]):
                yield (paths[lo], starts[lo]), (b"}".join(pieces[lo:hi]) + b"}").decode("utf-8", "replace"), [c[lo].as_py() for c in batch.columns[3:]]
                lo = hi


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, walks, size = None, (), 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "start": now[1], "size": size, **{f"{k}{h}": v for h, w in enumerate(walks) for k, v in (("closed", w.closed), ("opened", w.stack), ("in_string", w.in_string))}}])

    for part, text, (file_size,) in _chunks(batches):
        if part != now:
            if now:
                yield row()
            now, walks, size = part, (Walk(False), Walk(True)), file_size
        for w in walks:
            for _ in w.marks(text):
                pass
    if now:
        yield row()


def _composed(parts: pd.DataFrame) -> pd.DataFrame:
    """Where each part of a file stands at its start: path, start, in_string, stack, origin (the part in which the open row object began)."""
    out, in_string, stack, origin = [], False, "", -1
    for r in parts.sort_values("start").to_dict("records"):
        out.append((r["path"], r["start"], in_string, stack, origin))
        h = int(in_string)
        left = max(0, len(stack) - r[f"closed{h}"])
        same = _within(stack) and left > stack.index("{")
        stack, in_string = stack[:left] + r[f"opened{h}"], bool(r[f"in_string{h}"])
        origin = origin if same else r["start"] if _within(stack) else -1
    return pd.DataFrame(out, columns=["path", "start", "in_string", "stack", "origin"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, origin, start, value: whole objects (origin -1), and the pieces of those that reach over parts."""
    out, size, now, walk, held, origin = [], 0, None, None, [], -1

    def rows() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["path", "origin", "start", "value"])

    def ended() -> None:
        if held:
            out.append((now[0], now[1] if origin < 0 else origin, now[1], "".join(held)))

    for part, text, (in_string, stack, before) in _chunks(batches):
        if part != now:
            ended()
            now, walk, held, origin = part, Walk(in_string, stack), [], before
        begin = 0 if _within(walk.stack) else None
        for at, c in walk.marks(text):
            if c == "{" and begin is None and walk.stack in ("", "["):
                begin, held = at, []
            elif c == "}" and begin is not None and walk.stack in ("{", "[{"):
                value = "".join(held) + text[begin : at + 1]
                out.append((now[0], origin, now[1], value))
                size += len(value)
                begin, held, origin = None, [], -1
        if begin is not None:
            held.append(text[begin:])
        if size > 1 << 22:
            yield rows()
            out, size = [], 0
    ended()
    if out:
        yield rows()


def _recovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects in text that is none by itself: where it has no JSON, reading goes on with the next line."""
    decoder = json.JSONDecoder()
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            at = 0
            while at < len(text):
                try:
                    value, at = decoder.raw_decode(text, at)
                except json.JSONDecodeError:
                    at = at + 1 if text[at].isspace() else text.find("\n", at) + 1 or len(text)
                    continue
                out += [json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """value: each object, as JSON text, of files that are an array, lines of JSON, or objects one after another over any number of lines.

    All files are read in parts of spark.sql.files.maxPartitionBytes, those of one line as well. Of lists at the top the objects count, of other values none. Where a file has no JSON, reading goes on with the next line;
    only what a broken object encloses is then gone through by one task.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    # A line is an object by itself if a parser takes it; two objects on a line are told by the text between them.
    single = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{") & ~F.col("value").rlike(r"\}\s*\{")
    if not lines.where(~F.coalesce(single, F.lit(False))).limit(1).collect():
        return lines.select("value")
    work = Workspace(spark, "objects")
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_size").alias("size"))
    told = "path string, start long, size long, " + ", ".join(f"closed{h} long, opened{h} string, in_string{h} boolean" for h in (0, 1))
    parts = work.keep(pieces.mapInArrow(_transitions, told), "parts")  # one row for each part
    states = work.keep(parts.groupBy("path").applyInPandas(_composed, "path string, start long, in_string boolean, stack string, origin long"), "states")
    # A row of about a hundred bytes for each part of a file (128 MB by default) goes to where the parts are read.
    known = pieces.drop("size").join(F.broadcast(states), ["path", "start"]).select("path", "start", "piece", "in_string", "stack", "origin")
    cut = work.keep(known.mapInArrow(_cut, "path string, origin long, start long, value string"), "cut")
    over = cut.where("origin >= 0").groupBy("path", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("x")).select(F.array_join(F.transform("x", lambda p: p["value"]), "").alias("value"))
    found = cut.where("origin < 0").select("value").unionByName(over)
    sound = F.try_parse_json("value").isNotNull()
    return found.where(sound).unionByName(found.where(~sound).mapInArrow(_recovered, "value string"))
