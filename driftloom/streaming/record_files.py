"""A client of the record sink and source that keeps its calls as JSON lines, for dry runs and replays.

``option("client_factory", "driftloom.streaming.record_files:client")`` takes it, with
``option("records_path", uri)`` for a folder that all executors reach.  With
``records_shards`` a record goes to the shard that its key names, a folder below; a file's name
begins with the time at which its records arrived.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from datetime import datetime, timezone
from typing import Any
from zlib import crc32

from pyarrow.fs import FileSelector, FileSystem, FileType

FACTORY = "driftloom.streaming.record_files:client"


class FileClient:
    """Each call is a file for each of its shards; lines have partition_key and data."""

    def __init__(self, uri: str, shards: int = 0) -> None:
        self.files, self.folder = FileSystem.from_uri(uri)
        self.shards = shards
        for shard in self._names():
            self.files.create_dir(f"{self.folder}/{shard}", recursive=True)

    def _names(self) -> list[str]:
        return [f"shard={k}" for k in range(self.shards)] or [""]

    def put_records(self, StreamName: str, Records: list[dict]) -> dict[str, Any]:  # noqa: N803
        dealt = defaultdict(list)
        for k, r in enumerate(Records):
            dealt[crc32(r["PartitionKey"].encode()) % self.shards if self.shards else 0].append((k, r))
        answers: list[dict] = [{}] * len(Records)
        for shard, own in dealt.items():
            lines = [json.dumps({"partition_key": r["PartitionKey"], "data": r["Data"].decode()}) for _, r in own]
            name = f"{round(time.time() * 1000):015d}-{uuid.uuid4().hex}"
            with self.files.open_output_stream(f"{self.folder}/{self._names()[shard]}/{name}.json") as out:
                out.write(("\n".join(lines) + "\n").encode())
            for n, (k, _) in enumerate(own):
                answers[k] = {"SequenceNumber": f"{name}-{n:06d}", "ShardId": self._names()[shard]}
        return {"FailedRecordCount": 0, "Records": answers}

    def list_shards(self, **_: Any) -> dict[str, Any]:
        return {"Shards": [{"ShardId": name} for name in self._names()]}

    def get_shard_iterator(self, ShardId: str, ShardIteratorType: str, Timestamp: datetime | None = None, **_: Any) -> dict[str, Any]:  # noqa: N803
        since = round(Timestamp.timestamp() * 1000) if ShardIteratorType == "AT_TIMESTAMP" else 0
        return {"ShardIterator": json.dumps([ShardId, f"{since:015d}", 0])}

    def get_records(self, ShardIterator: str, Limit: int) -> dict[str, Any]:  # noqa: N803
        """Records of the files from the iterator's on, ``Limit`` at most."""
        shard, name, line = json.loads(ShardIterator)
        found = self.files.get_file_info(FileSelector(f"{self.folder}/{shard}"))
        names = sorted(f.base_name for f in found if f.type == FileType.File and f.base_name.endswith(".json") and f.base_name >= name)
        out: list[dict] = []
        for own in names:
            with self.files.open_input_stream(f"{self.folder}/{shard}/{own}") as lines:
                rows = lines.read().decode().splitlines()
            arrived = datetime.fromtimestamp(int(own[:15]) / 1000, timezone.utc)
            first = line if own == name else 0
            upto = min(len(rows), first + Limit - len(out))
            for k, row in enumerate(rows[first:upto], first):
                said = json.loads(row)
                out.append(
                    {"Data": said["data"].encode(), "PartitionKey": said["partition_key"], "SequenceNumber": f"{own[:-5]}-{k:06d}", "ApproximateArrivalTimestamp": arrived}
                )
            name, line = own, upto
            if len(out) >= Limit:
                break
        return {"Records": out, "NextShardIterator": json.dumps([shard, name, line if names else 0]), "MillisBehindLatest": 0}


def client(options: dict[str, str]) -> FileClient:
    if not options.get("records_path"):
        raise ValueError("records_path is required")
    return FileClient(options["records_path"], int(options.get("records_shards", 0)))
