"""Safe access to the files below a root: walking, reading and replacing without following links."""

from __future__ import annotations

import contextlib
import hashlib
import os
import secrets
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from cuespark.kernel.formats import detect_format

MOST_BYTES = 64 << 20


class FileProblem(Exception):
    """Why a file is kept out: ``kind`` is unreadable, too-large, symlink, hardlink, unsafe or conflict."""

    def __init__(self, kind: str, message: str, size: int | None = None):
        super().__init__(message)
        self.kind, self.message, self.size = kind, message, size


@dataclass(frozen=True)
class Found:
    """A supported name below a root: a candidate (``kind`` null) or an issue of that kind."""

    path: str
    size: int | None
    kind: str | None = None
    message: str | None = None


@dataclass(frozen=True)
class Content:
    """A file as it was read, with what identifies this version of it."""

    data: bytes
    sha256: str
    size: int
    mode: int
    mtime_ns: int
    uid: int
    gid: int
    identity: tuple[str, int, int]


def safe_relative(path: str) -> bool:
    """Whether a path is relative, clean and stays below its root."""
    return bool(path) and "\0" not in path and not path.startswith("/") and not {"", ".", ".."} & set(path.split("/"))


def classify(path: str, info: os.stat_result, most: int = MOST_BYTES) -> Found:
    """What a directory entry is, by its own status (links not followed)."""
    if stat.S_ISLNK(info.st_mode):
        return Found(path, None, "symlink", "symbolic link")
    if not stat.S_ISREG(info.st_mode):
        return Found(path, info.st_size, "unsafe", "no regular file")
    if info.st_size > most:
        return Found(path, info.st_size, "too-large", f"larger than {most} bytes")
    return Found(path, info.st_size)


def walk(root: str, below: str = "", most: int = MOST_BYTES, deep: bool = True) -> Iterator[Found | str]:
    """The supported entries below a directory of ``root``; with ``deep`` off, subdirectories are given as names instead.

    Directories whose name begins with a dot are left out, links to directories are not followed,
    and other extensions don't count.
    """
    at = os.path.join(root, below) if below else root
    try:
        entries = sorted(os.scandir(at), key=lambda e: e.name)
    except OSError:
        if not below:
            raise
        return
    for entry in entries:
        path = f"{below}/{entry.name}" if below else entry.name
        if entry.is_dir(follow_symlinks=False):
            if not entry.name.startswith("."):
                if deep:
                    yield from walk(root, path, most)
                else:
                    yield path
        elif detect_format(path):
            try:
                yield classify(path, entry.stat(follow_symlinks=False), most)
            except OSError as e:
                yield Found(path, None, "unreadable", str(e))


def look(root: str, path: str, most: int = MOST_BYTES) -> Found:
    """One named entry, which may be missing; nothing beside it is looked at."""
    try:
        return classify(path, os.lstat(os.path.join(root, path)), most)
    except OSError as e:
        return Found(path, None, "unreadable", e.strerror or str(e))


@contextlib.contextmanager
def open_parent(root: str, path: str) -> Iterator[tuple[int, str]]:
    """A handle of the directory that holds ``path``, reached without following a link, and the last name."""
    if not safe_relative(path):
        raise FileProblem("unsafe", "path is not safe")
    *parents, name = path.split("/")
    handle = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for part in parents:
            try:
                below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=handle)
            except FileNotFoundError:
                raise FileProblem("unreadable", "no such file or directory") from None
            except OSError as e:
                raise FileProblem("unsafe", f"a parent is no plain directory: {e.strerror}") from None
            os.close(handle)
            handle = below
        yield handle, name
    finally:
        os.close(handle)


def _identity(info: os.stat_result) -> tuple[str, int, int]:
    return ("unix", info.st_dev, info.st_ino)


def read_safe(root: str, path: str, sha256: str | None = None, identity: tuple | None = None, most: int = MOST_BYTES) -> Content:
    """The bytes of a regular, singly linked file that doesn't change while it is read.

    With ``sha256`` or ``identity``, another version than that is a conflict.
    """
    with open_parent(root, path) as (parent, name):
        try:
            file = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=parent)
        except OSError as e:
            linked = False
            with contextlib.suppress(OSError):
                linked = stat.S_ISLNK(os.stat(name, dir_fd=parent, follow_symlinks=False).st_mode)
            raise FileProblem("unsafe" if linked else "unreadable", e.strerror or str(e)) from None
        with os.fdopen(file, "rb") as f:
            before = os.fstat(f.fileno())
            if not stat.S_ISREG(before.st_mode):
                raise FileProblem("unsafe", "no regular file", before.st_size)
            if before.st_nlink > 1:
                raise FileProblem("hardlink", "file has several hard links", before.st_size)
            if before.st_size > most:
                raise FileProblem("unreadable", f"larger than {most} bytes", before.st_size)
            data = f.read(most + 1)
            after = os.fstat(f.fileno())
        if len(data) != after.st_size or (before.st_size, _identity(before)) != (after.st_size, _identity(after)):
            raise FileProblem("conflict", "file changed while it was read", after.st_size)
    digest = hashlib.sha256(data).hexdigest()
    if (sha256 is not None and digest != sha256) or (identity is not None and tuple(identity) != _identity(after)):
        raise FileProblem("conflict", "file changed since it was scanned", after.st_size)
    return Content(data, digest, after.st_size, stat.S_IMODE(after.st_mode), after.st_mtime_ns, after.st_uid, after.st_gid, _identity(after))


def write_durably(directory: str, name: str, data: bytes | Iterator[bytes], mode: int = 0o600) -> None:
    """A file written beside its place, flushed, and moved there."""
    staged = os.path.join(directory, f".{name}.{secrets.token_hex(6)}")
    file = os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, mode)
    try:
        with os.fdopen(file, "wb") as f:
            f.writelines([data] if isinstance(data, bytes) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, os.path.join(directory, name))
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(staged)
        raise
    sync_directory(directory)


def sync_directory(directory: str) -> None:
    handle = os.open(directory, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


class ReplaceFailed(Exception):
    """A replacement that failed; ``attempted`` tells whether the target may have changed."""

    def __init__(self, message: str, attempted: bool):
        super().__init__(message)
        self.attempted = attempted


def replace_file(root: str, path: str, expected: Content | str, data: bytes, mode: int, mtime_ns: int, owner: tuple[int, int]) -> list[str]:
    """Puts ``data`` in place of a file whose version is still the expected one; gives warnings.

    The new bytes are staged in the same directory with the old mode, owner, extended attributes and
    time, flushed and verified; the target is checked once more before it is moved over.
    """
    sha256, identity = (expected, None) if isinstance(expected, str) else (expected.sha256, expected.identity)
    warnings: list[str] = []
    with open_parent(root, path) as (parent, name):
        staged = f".{name}.{secrets.token_hex(6)}.part"
        attempted = False
        try:
            file = os.open(staged, os.O_RDWR | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600, dir_fd=parent)
            with os.fdopen(file, "r+b") as f:
                f.write(data)
                f.flush()
                if (os.geteuid(), os.getegid()) != owner:
                    try:
                        os.fchown(f.fileno(), *owner)
                    except OSError as e:
                        warnings.append(f"owner could not be kept: {e.strerror}")
                with contextlib.suppress(OSError):
                    source = os.open(name, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=parent)
                    try:
                        for key in os.listxattr(source):
                            os.setxattr(f.fileno(), key, os.getxattr(source, key))
                    finally:
                        os.close(source)
                os.fchmod(f.fileno(), mode)
                f.seek(0)
                if hashlib.sha256(f.read()).digest() != hashlib.sha256(data).digest():
                    raise ReplaceFailed("staged bytes differ", False)
                os.utime(f.fileno(), ns=(mtime_ns, mtime_ns))
                os.fsync(f.fileno())
            read_safe(root, path, sha256, identity)
            attempted = True
            os.replace(staged, name, src_dir_fd=parent, dst_dir_fd=parent)
            os.fsync(parent)
        except FileProblem:
            raise
        except OSError as e:
            raise ReplaceFailed(e.strerror or str(e), attempted) from None
        finally:
            with contextlib.suppress(OSError):
                os.unlink(staged, dir_fd=parent)
    return warnings
