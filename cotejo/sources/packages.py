"""Files packed into ZIP packages, for more of them than a file system should hold one by one, whole or not at all, and read again.

A small file takes a block, a number and often a folder of its own, whatever it holds: millions of them fill a disk several times over. Rows (name string, body string)
become members of packages `<path>/<id>.zip`, deflated, which any unzip turns into the files `<name>`. Every task attempt writes packages of its own under `<path>/_staging`;
what the attempts that counted have written becomes a table of names. Only when all have ended well and no name stands twice do tasks move the packages to their names.
"""

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cotejo.sources.files import BATCH, STAGING, _at, _checked, _clear, _moved
from cotejo.sources.written import durable

#: Bytes beyond which a package takes no further file. A task holds one package.
PACKAGE = 16_000_000


def _member(name: str | None) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(_checked(name))
    if info.filename != name or info.is_dir():
        raise ValueError(f"no file can have the name {name!r}")
    info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
    return info


def _pack(path: str, run: str, most: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    where, base = _at(path)
    held, package, key = None, None, ""

    def close() -> None:
        package.close()
        with where.open_output_stream(f"{base}/{STAGING}/{run}/{key}.zip") as f:
            f.write(held.getbuffer())

    for block in batches:
        keys = []
        for name, body in zip(block["name"], block["body"]):
            if package is not None and held.tell() > most:
                close()
                package = None
            if package is None:
                held, key = io.BytesIO(), uuid.uuid4().hex
                package = zipfile.ZipFile(held, "w")
            package.writestr(_member(name), (body or "").encode())
            keys.append(key)
        yield pd.DataFrame({"name": block["name"], "package": keys})
    if package is not None:
        close()


def _place(path: str, run: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    where, base = _at(path)
    for block in batches:
        for key in block["package"]:
            _moved(where, f"{base}/{STAGING}/{run}/{key}.zip", f"{base}/{key}.zip")
        yield pd.DataFrame({"n": [len(block)]})


def put_packages(rows: DataFrame, path: str, most: int = PACKAGE) -> DataFrame:
    """rows (name, body) as members of packages under path. Returns (name, package) of each, as a table."""
    run = uuid.uuid4().hex
    where, base = _at(path)
    where.create_dir(f"{base}/{STAGING}/{run}", recursive=True)
    try:
        packed = durable(rows.select("name", "body").mapInPandas(lambda b: _pack(path, run, most, b), "name string, package string"), "files")
        twice = packed.groupBy("name").count().where("count > 1").select("name").head()
        if twice:
            raise ValueError(f"two rows for the file {twice[0]!r}")
        packed.select("package").distinct().mapInPandas(lambda b: _place(path, run, b), "n long").groupBy().sum("n").collect()
    finally:
        _clear(path, run)
    return packed


def read_packages(names: DataFrame, path: str) -> DataFrame:
    """(name, body) of the files of those (name, package) under path. A package is read by one task, as many tasks as there are packages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = _at(path)
        package, key = None, None
        for block in batches:
            held, size = [], 0
            for name, of in zip(block["name"], block["package"]):
                if of != key:
                    with where.open_input_stream(f"{base}/{of}.zip") as f:
                        package, key = zipfile.ZipFile(io.BytesIO(f.read())), of
                held.append((name, package.read(name).decode()))
                size += len(held[-1][1])
                if size > BATCH:
                    yield pd.DataFrame(held, columns=["name", "body"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["name", "body"])

    n = names.select("package").distinct().count()
    return names.select("name", "package").repartition(max(1, n), "package").sortWithinPartitions("package").mapInPandas(read, "name string, body string")
