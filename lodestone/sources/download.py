"""Files from elsewhere: fetched once, checked, unpacked once. Nothing here runs unless it is asked for."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import urllib.request
import zipfile
from pathlib import Path

#: What a corpus folder has.
LAYOUT = ("raw", "images", "tables", "embeddings", "indexes", "results")


def layout(root: str) -> dict[str, Path]:
    """The folders of a corpus, made where they are missing."""
    found = {name: Path(root) / name for name in LAYOUT}
    for path in found.values():
        path.mkdir(parents=True, exist_ok=True)
    return found


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(url: str, target: str, sha256: str | None = None, attempts: int = 3, timeout: float = 60.0) -> Path:
    """The file of a URL. One that is there already, and has the digest if one is given, is not fetched again.

    The file appears under its name only when it is whole; a wrong digest or the last failed attempt raises.
    """
    path = Path(target)
    if path.is_file() and (sha256 is None or _digest(path) == sha256):
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:  # noqa: S310
                shutil.copyfileobj(source, out, 1 << 20)
            if sha256 is not None and (got := _digest(part)) != sha256:
                raise ValueError(f"{url}: digest {got}, expected {sha256}")
            os.replace(part, path)
            return path
        except OSError:
            if attempt == attempts:
                raise
    raise ValueError("attempts must be 1 or more")


def extract(archive: str, directory: str) -> Path:
    """Unpacks a zip or tar file, unless that has been done. Members that would lie outside the folder are refused."""
    target = Path(directory)
    mark = target / f".{Path(archive).name}.done"
    if mark.is_file():
        return target
    target.mkdir(parents=True, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if not (target / name).resolve().is_relative_to(target.resolve()):
                    raise ValueError(f"{archive}: {name} lies outside {directory}")
            z.extractall(target)  # noqa: S202
    else:
        with tarfile.open(archive) as t:
            t.extractall(target, filter="data")
    mark.touch()
    return target


def fetch_corpus(urls: dict[str, str], root: str, digests: dict[str, str] | None = None) -> dict[str, Path]:
    """Fetches files by name into the corpus's raw folder and unpacks archives beside its images; gives the files' places."""
    folders, found = layout(root), {}
    for name, url in urls.items():
        found[name] = fetch(url, str(folders["raw"] / name), (digests or {}).get(name))
        if name.endswith((".zip", ".tar", ".tar.gz", ".tgz")):
            extract(str(found[name]), str(folders["images"]))
    return found
