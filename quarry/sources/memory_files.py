"""The sink of memory files: front matter and body, written anew or merged into the file that a target names."""

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _document(name: str, description: str, kind: str, body: str) -> str:
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ") + '"'
    return f"---\nname: {quoted(name)}\ndescription: {quoted(description)}\ntype: {kind}\n---\n\n{body.strip()}\n"


def body_of(document: str) -> str:
    """What follows the front matter."""
    text = document.replace("\r\n", "\n")
    end = text.find("\n---\n")
    return text[end + 5 :].strip() if text.startswith("---\n") and end >= 0 else text.strip()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        actions = []
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["path"])
            there = store.get_file_info(path).type == fs.FileType.File
            body = row["body"]
            if there:
                with store.open_input_stream(path) as f:
                    old = body_of(f.read().decode("utf-8", "replace"))
                body = old if body.strip() in old else f"{old}\n\n{body.strip()}"  # a task that runs again adds nothing
            store.create_dir(path.rpartition("/")[0], recursive=True)
            own = f"{path}.tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(_document(row["name"] or "", row["description"] or "", row["type"], body).encode())
            store.move(own, path)  # readers see the old file or the new one
            actions.append("updated" if there else "created")
        yield pa.RecordBatch.from_arrays([batch["id"], batch["path"], pa.array(actions, pa.string())], names=["id", "path", "action"])


def write(memories: DataFrame, folder: str) -> DataFrame:
    """Write memories (id, file, target, name, description, type, body) under a folder (local or a URI that pyarrow writes); returns (id, path, action).

    target is the path of a file to merge into (semantic.write_targets says which), null: `file` in the folder. Into a file that is there already the body is added,
    unless it holds it. Memories of one path are written one after the other, by id. Those without a body or a type are left out. The result is written
    when it is asked for, each time; so land it once.
    """
    rows = memories.where("trim(coalesce(body, '')) <> '' and trim(coalesce(type, '')) <> ''")
    rows = rows.select("id", F.coalesce("target", F.concat(F.lit(folder.rstrip("/") + "/"), "file")).alias("path"), "name", "description", "type", "body")
    kind = memories.schema["id"].dataType.simpleString()
    return rows.repartition("path").sortWithinPartitions("path", "id").mapInArrow(_written, f"id {kind}, path string, action string")
