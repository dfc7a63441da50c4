"""A log of paid calls in the shared folder: whoever runs a batch again, a retried or a speculative task, or a later run under the same name, reads the answer instead of paying twice."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..operators.graph import listed, shared_folder


@dataclass(frozen=True)
class CallLog:
    """Answers by call, one file each. folder: one that driver and executors share and pyarrow can open (file, hdfs, s3, gs ...), with the name of the run in it.

    A file is written under another name and then moved to its own, so a half-written answer is never read. Between a model's answer and its file a dying task still loses that one call: what nobody wrote down has to be paid again.
    """

    folder: str

    @classmethod
    def of(cls, spark: SparkSession, run: str | None = None) -> CallLog:
        """The log of a run in spark.checkpoint.dir; runs of one name share their answers. ValueError if pyarrow cannot open that folder."""
        place = f"{shared_folder(spark)}/calls-{run or uuid.uuid4().hex}"
        log = cls(place if run else listed(place))  # a named log outlives the scratch() around
        try:
            fs, path = log._open()
            fs.create_dir(path, recursive=True)
        except Exception as e:
            raise ValueError(f"no log of calls in {log.folder}: {e}") from e
        return log

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    @staticmethod
    def name(*call: Any) -> str:
        """Of a call: a digest of all that the model is given."""
        return sha256(json.dumps(call, sort_keys=True, default=str).encode()).hexdigest()

    def read(self, name: str) -> Any:
        fs, path = self._open()
        place = f"{path}/{name}.json"
        if fs.get_file_info(place).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(place) as f:
            return json.loads(f.read())

    def write(self, name: str, answer: Any) -> None:
        fs, path = self._open()
        beside = f"{path}/_{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(json.dumps(answer).encode())
        fs.move(beside, f"{path}/{name}.json")

    def once(self, call: tuple, ask: Callable[[], Any]) -> Any:
        """The answer of a call (JSON values) from the log, else of ask(), which is then written down. An exception isn't."""
        name = self.name(*call)
        found = self.read(name)
        if found is None:
            found = {"answer": ask()}
            self.write(name, found)
            found = json.loads(json.dumps(found))
        return found["answer"]

    def drop(self) -> None:
        """Delete the log, once a run's results are published."""
        fs, path = self._open()
        fs.delete_dir(path)
