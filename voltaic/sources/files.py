"""Files of any store that pyarrow knows, for sources and sinks that run in Python workers. A path without a scheme is a local one."""

from __future__ import annotations

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def parent(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else "."


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def children(path: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a folder, bytes) of what a folder has, by name; a folder that isn't there has nothing."""
    at, inner = store(path)
    found = at.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    return sorted((f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found)


def walk(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files under a folder, by path."""
    out = []
    for name, folder, size in children(path):
        out += walk(join(path, name)) if folder else [(join(path, name), size)]
    return sorted(out)


def size(path: str) -> int:
    at, inner = store(path)
    return at.get_file_info(inner).size or 0


def exists(path: str) -> bool:
    at, inner = store(path)
    return at.get_file_info(inner).type != fs.FileType.NotFound


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    at, inner = store(path)
    with at.open_input_file(inner) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def write(path: str):
    """An output stream; folders on the way are made."""
    at, inner = store(path)
    at.create_dir(parent(inner), recursive=True)
    return at.open_output_stream(inner)


def move(a: str, b: str) -> None:
    at, inner = store(a)
    at.move(inner, store(b)[1])


def delete(path: str) -> None:
    """A folder with all it has; nothing, if it isn't there."""
    if exists(path):
        at, inner = store(path)
        at.delete_dir(inner)
