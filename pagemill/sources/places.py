"""Small files and folders by address, from the driver or a task, through pyarrow."""

from __future__ import annotations

import atexit
import json
import re
import uuid


def opened(address: str):
    """(file system, path) of an address; local paths may come without a scheme."""
    import pyarrow.fs

    if "://" not in address and not address.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), address
    return pyarrow.fs.FileSystem.from_uri(address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address)


def place_of(address: str, value: dict | None = None) -> dict | None:
    """The JSON object stored at an address (None where there is none); with ``value`` that is stored first, whole or not at all."""
    import pyarrow.fs

    fs, path = opened(address)
    if value is not None:
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(value).encode())
        fs.move(f"{path}.new", path)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def shared(spark, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``, which all executors see.

    Where the setting is missing, a session on one machine gets a folder there; a cluster is refused.
    The folder is removed when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{(root or '/tmp/checkpoints').rstrip('/')}/pagemill-{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, folder)
    return folder


def removed(spark, folder: str) -> None:
    """Deletes a folder on any file system Spark reaches."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already
        pass
