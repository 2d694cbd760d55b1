"""Files made of rows, whole or not at all, and read again; the driver holds none of their names.

Rows (name string, body string) become files `<path>/<name>`. Every task attempt writes to a folder of its own under `<path>/_staging`, and what the attempts
that counted have written becomes a table. Only when all have ended well and no name stands twice do tasks move the files to their names. A failed job leaves
nothing but what stood there before: the run's folder is made once, by the driver, so an attempt that outlives its job finds no folder to write to.
"""

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

from cotejo.sources.written import durable

STAGING = "_staging"
#: Bodies that one batch of a read holds, in characters.
BATCH = 4_000_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(path)
    return where, base.rstrip("/")


def _checked(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0] == STAGING:
        raise ValueError(f"no file can have the name {name!r}")
    return name


def _stage(path: str, run: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    where, base = _at(path)
    folder, n = f"{base}/{STAGING}/{run}/{uuid.uuid4().hex}", 0
    for block in batches:
        staged = []
        for name, body in zip(block["name"], block["body"]):
            _checked(name)
            if n == 0:
                where.create_dir(folder, recursive=False)
            # In one flat folder until the job has ended.
            with where.open_output_stream(f"{folder}/{n}") as f:
                f.write((body or "").encode())
            staged.append(f"{folder}/{n}")
            n += 1
        yield pd.DataFrame({"name": block["name"], "staged": staged})


def _moved(where: fs.FileSystem, staged: str, to: str) -> None:
    try:
        where.move(staged, to)
    except FileNotFoundError:
        # An earlier attempt of this task has moved it.
        if where.get_file_info(to).type != fs.FileType.File:
            raise


def _place(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    where, base = _at(path)
    there = None
    for block in batches:
        for name, staged in zip(block["name"], block["staged"]):
            folder = f"{base}/{name}".rpartition("/")[0]
            if folder != there:
                where.create_dir(folder, recursive=True)
                there = folder
            _moved(where, staged, f"{base}/{name}")
        yield pd.DataFrame({"n": [len(block)]})


def _clear(path: str, run: str) -> None:
    """The run's folder goes, even while attempts that are being stopped still write into it; then the folder of all runs, if it is empty."""
    where, base = _at(path)
    for _ in range(100):
        try:
            if where.get_file_info(f"{base}/{STAGING}/{run}").type == fs.FileType.Directory:
                where.delete_dir(f"{base}/{STAGING}/{run}")
            if where.get_file_info(f"{base}/{STAGING}").type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(f"{base}/{STAGING}")):
                where.delete_dir(f"{base}/{STAGING}")
            return
        except OSError:
            time.sleep(0.1)
    raise RuntimeError(f"{base}/{STAGING}/{run} could not be removed")


def put_files(rows: DataFrame, path: str) -> DataFrame:
    """rows (name, body) as files under path. Returns their names, as a table."""
    run = uuid.uuid4().hex
    where, base = _at(path)
    where.create_dir(f"{base}/{STAGING}/{run}", recursive=True)
    try:
        staged = durable(rows.select("name", "body").mapInPandas(lambda b: _stage(path, run, b), "name string, staged string"), "files")
        twice = staged.groupBy("name").count().where("count > 1").select("name").head()
        if twice:
            raise ValueError(f"two rows for the file {twice[0]!r}")
        staged.repartition("name").mapInPandas(lambda b: _place(path, b), "n long").groupBy().sum("n").collect()
    finally:
        _clear(path, run)
    return staged.select("name")


def write_files(rows: DataFrame, path: str) -> str:
    """rows (name, body) as files under path. Returns path."""
    put_files(rows, path)
    return path


def read_files(names: DataFrame, path: str) -> DataFrame:
    """(name, body) of the files of those names under path, read by the tasks that have the names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = _at(path)
        for block in batches:
            held, size = [], 0
            for name in block["name"]:
                with where.open_input_stream(f"{base}/{name}") as f:
                    held.append((name, f.read().decode()))
                size += len(held[-1][1])
                if size > BATCH:
                    yield pd.DataFrame(held, columns=["name", "body"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["name", "body"])

    return names.select("name").repartition("name").mapInPandas(read, "name string, body string")
