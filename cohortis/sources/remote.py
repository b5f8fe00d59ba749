"""Files of a remote dataset brought into a shared folder, and placed in a dataset's tree."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are held of a file at once.
BLOCK = 1 << 20
#: What can become of a file: it was there, was fetched, or couldn't be.
STATUS = ("present", "downloaded", "failed")


def sha1_of(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha1").hexdigest()


def _stream(url: str, place: Path) -> str:
    """Write a url's bytes to a place; their SHA-1."""
    seen = hashlib.sha1()
    with urllib.request.urlopen(url, timeout=120) as answer, open(place, "wb") as out:
        while block := answer.read(BLOCK):
            out.write(block)
            seen.update(block)
    return seen.hexdigest()


def fetch(url: str, place: Path, size: int, sha1: str, retries: int = 3, verify: bool = True, wait: Callable[[float], None] = time.sleep) -> str:
    """`present` where the file is there in its size (and, with verify, its hash), else `downloaded`.

    Bytes go to a part file of this process's own, which takes the name only if the hash fits; waits of 2, 4, ... seconds lie
    between attempts, and after the last OSError is raised.
    """
    if place.is_file() and place.stat().st_size == size and (not verify or sha1_of(place) == sha1):
        return "present"
    place.parent.mkdir(parents=True, exist_ok=True)
    part = place.with_name(f"{place.name}.{os.getpid()}.part")
    problem: OSError | None = None
    for attempt in range(retries):
        if attempt:
            wait(2.0**attempt)
        try:
            got = _stream(url, part)
            if got == sha1:
                os.replace(part, place)
                return "downloaded"
            problem = OSError(f"SHA-1 {got} for {sha1}")
        except OSError as e:
            problem = e
        part.unlink(missing_ok=True)
    raise OSError(f"{url}: {retries} attempts, the last: {problem}")


def fetch_all(files: DataFrame, folder: str, url: str, connections: int = 8, retries: int = 3, verify: bool = True) -> DataFrame:
    """files (schemas.MANIFEST's remote_path, local_path, file_id, size, sha1) with status and problem, fetched by `connections` tasks
    at once into a folder that all executors share. url holds {file_id}. A file that fails is a row that says so, and a task
    that is run again finds what the first left."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append((fetch(url.format(file_id=r.file_id), Path(folder) / r.local_path, r.size, r.sha1, retries, verify), None))
                except OSError as e:
                    out.append(("failed", str(e)))
            pdf["status"], pdf["problem"] = [s for s, _ in out], [p for _, p in out]
            yield pdf

    wanted = files.select("remote_path", "local_path", "file_id", "size", "sha1")
    return wanted.repartition(connections, F.xxhash64("remote_path")).mapInPandas(run, "remote_path string, local_path string, file_id string, size long, sha1 string, status string, problem string")


def place(source: Path, target: Path) -> str:
    """Give a file a second name: `present` where the target has its size, `hardlink`, or `copy` where links can't be made."""
    if target.exists() and target.stat().st_size == source.stat().st_size:
        return "present"
    target.unlink(missing_ok=True)
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.link(source, target)
    except OSError:
        shutil.copy2(source, target)
        return "copy"
    return "hardlink"


def place_all(plan: DataFrame, source: str, target: str, tasks: int = 8) -> DataFrame:
    """plan (from_path, to_path, relative to the two folders) with status: what place() did, or `missing` without a source."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = []
            for a, b in zip(pdf.from_path, pdf.to_path, strict=True):
                known = isinstance(a, str) and (Path(source) / a).is_file()
                done.append(place(Path(source) / a, Path(target) / b) if known else "missing")
            yield pdf.assign(status=done)

    return plan.select("from_path", "to_path").repartition(tasks, F.xxhash64("to_path")).mapInPandas(run, "from_path string, to_path string, status string")
