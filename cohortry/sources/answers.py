"""Answers of a slow or costly client, asked for once: a data source whose writer calls the client and whose files are the log of answers."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_SCHEMA = "h string, response string, error string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; a bare path is local."""
    return fs.FileSystem.from_uri(path.rstrip("/")) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))


@dataclass
class _Said(WriterCommitMessage):
    asked: int
    failed: int


class _Bucket:
    """The answers of one bucket: files of lines, each written whole as soon as its prompts are answered."""

    def __init__(self, path: str, bucket: int):
        self.system, root = _system(path)
        self.root = f"{root}/bucket={bucket}"
        self.system.create_dir(self.root, recursive=True)
        self.files = [i.path for i in self.system.get_file_info(fs.FileSelector(self.root)) if i.path.endswith(".jsonl")]
        self.known: dict[str, str] = {}
        for f in self.files:
            with self.system.open_input_stream(f) as s:
                self.known.update((r["h"], line) for line in s.read().decode().splitlines() if (r := json.loads(line)))

    def put(self, lines: list[str], suffix: str = "jsonl") -> str:
        """A file appears by its name only once it is whole."""
        name = f"{self.root}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(f"{name}.tmp") as s:
            s.write("".join(x + "\n" for x in lines).encode())
        self.system.move(f"{name}.tmp", f"{name}.{suffix}")
        return f"{name}.{suffix}"

    def gathered(self) -> None:
        """One file in place of many."""
        if len(self.files) > 1:
            whole = self.put(list(self.known.values()))
            for f in self.files:
                self.system.delete_file(f)
            self.files = [whole]


def _source(name_: str, client: Callable[[str], str], attempts: int, pause: float, fatal: tuple[type[Exception], ...]) -> type[DataSource]:
    def ask(prompt: str) -> tuple[str | None, str | None]:
        why = None
        for n in range(attempts):
            try:
                got = client(prompt)
                json.loads(got)
                return got, None
            except fatal as e:
                return None, str(e)
            except Exception as e:  # noqa: BLE001  a client may fail in any way
                why = str(e)
                if n + 1 < attempts:
                    time.sleep(pause * (n + 1))
        return None, why

    class Writer(DataSourceWriter):
        def __init__(self, path: str):
            self.path = path

        def write(self, iterator):
            buckets: dict[int, _Bucket] = {}
            asked = failed = 0
            for r in iterator:
                own = buckets.get(r["bucket"]) or buckets.setdefault(r["bucket"], _Bucket(self.path, r["bucket"]))
                if r["h"] in own.known:  # by an attempt that did not live to end
                    continue
                got, why = ask(r["prompt"])
                asked += 1
                line = json.dumps({"h": r["h"], "response": got, "error": why})
                if why is None:
                    own.files.append(own.put([line]))
                    own.known[r["h"]] = line
                else:
                    failed += 1
                    own.put([line], "failed")
            for own in buckets.values():
                own.gathered()
            return _Said(asked, failed)

        def commit(self, messages):
            """Answers are in the log already; what is left to say is how many were asked for."""
            system, root = _system(self.path)
            said = {"asked": sum(m.asked for m in messages if m), "failed": sum(m.failed for m in messages if m), "at": time.time()}
            with system.open_output_stream(f"{root}/_run-{uuid.uuid4().hex}.json") as s:
                s.write(json.dumps(said).encode())

        def abort(self, messages):
            """Answers that were given stay."""

    class Answers(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return "h string, bucket int, prompt string"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return Answers


def _log(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).json(path)


def extract_once(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], path: str, buckets: int = 64, attempts: int = 4, pause: float = 1.25, fatal: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """(key, response, error) of each row: equal prompts are asked for once, and one that the log below ``path`` holds is not asked for again.

    Prompts are told apart by SHA-256 and dealt to buckets by it, so that one task writes a bucket. An answer is a file as soon as it is given: a task that is run again
    after it was lost reads its buckets' files first and asks for the rest. At its end a task gathers a bucket's files into one. A failed prompt has its last error and is asked for in
    the next run. ``path`` is a folder that all executors share, by any address that Arrow opens. Null prompts are not asked for: null response and error. Should two
    attempts of one task run at once, either may ask for a prompt that the other has under way.
    """
    spark = df.sparkSession
    h = F.sha2(F.col(prompt), 256)
    own = df.select(F.col(key).alias("k"), h.alias("h"), F.col(prompt).alias("prompt"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    system, root = _system(path)
    system.create_dir(root, recursive=True)
    open_ = own.where("h is not null").select("h", "prompt").dropDuplicates(["h"]).join(_log(spark, path, "jsonl").select("h").distinct(), "h", "left_anti")
    kind = f"answers_{uuid.uuid4().hex}"
    spark.dataSource.register(_source(kind, client, attempts, pause, fatal))
    open_.select("h", bucket.alias("bucket"), "prompt").repartition(buckets, "bucket").write.format(kind).option("path", path).mode("append").save()
    answers = _log(spark, path, "jsonl").groupBy("h").agg(F.first("response").alias("response"))
    failed = _log(spark, path, "failed").groupBy("h").agg(F.max("error").alias("error"))
    got = own.select("k", "h").join(answers, "h", "left").join(failed, "h", "left")
    return got.select(F.col("k").alias(key), "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))
