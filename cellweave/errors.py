"""One exception for each error code, so that callers can catch what they can handle."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors; ``code`` is the stable number of the kind."""

    code = 0

    @classmethod
    def kinds(cls) -> dict[int, type[StoreError]]:
        return {k.code: k for k in cls.__subclasses__()}


def _kind(name: str, code: int, about: str) -> type[StoreError]:
    return type(name, (StoreError,), {"code": code, "__doc__": about})


NoError = _kind("NoError", -1, "The absence of an error, for tables of codes.")
Unexpected = _kind("Unexpected", 0, "Anything without a kind of its own.")
BadDescriptor = _kind("BadDescriptor", 1, "A file can't be opened.")
SyncFailed = _kind("SyncFailed", 2, "Data could not be made durable.")
CloseFailed = _kind("CloseFailed", 3, "A file could not be closed.")
BadConfig = _kind("BadConfig", 4, "Bad arguments or settings, an empty value, a damaged record.")
WriteFailed = _kind("WriteFailed", 5, "A write failed.")
ReadFailed = _kind("ReadFailed", 6, "A read or a decoding failed.")
OutOfRange = _kind("OutOfRange", 7, "A read beyond the end of a buffer or file.")
EndOfLog = _kind("EndOfLog", 8, "No further record.")
StatFailed = _kind("StatFailed", 9, "The size of a file is unknown.")
BadMagic = _kind("BadMagic", 10, "A file of another format.")
BadFile = _kind("BadFile", 11, "A file that can't be used.")
Empty = _kind("Empty", 12, "Nothing to work on.")
StaleVersion = _kind("StaleVersion", 1001, "A version edit that is based on an older version.")
