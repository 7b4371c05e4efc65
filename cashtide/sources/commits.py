"""Numbered commits: the state of a folder as small JSON files, each put there only if absent.

A commit appears whole or not at all, by renaming a finished file, and its number can be taken only
once: of two writers that start from the same state one gets a ``Conflict``. Readers find the newest
commit from a hint and the few numbers after it, without listing the folder.
"""

import json
import uuid

from py4j.protocol import Py4JJavaError


class Conflict(Exception):
    """Another writer has taken the commit's number."""


def _at(spark, uri):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, uri):
    path, system = _at(spark, uri)
    return system.exists(path)


def _read(spark, uri):
    path, system = _at(spark, uri)
    size = system.getFileStatus(path).getLen()
    stream = system.open(path)
    try:
        return bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()


def _write(spark, uri, text, overwrite=False):
    path, system = _at(spark, uri)
    stream = system.create(path, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _file(uri, number):
    return f"{uri}/commits/{number:012d}.json"


def newest(spark, uri):
    """(number, state) of the newest commit; (-1, None) when there is none."""
    hint = f"{uri}/commits/hint"
    try:
        number = int(_read(spark, hint)) if exists(spark, hint) else -1
    except (Py4JJavaError, ValueError):  # being written anew just now
        number = -1
    while exists(spark, _file(uri, number + 1)):
        number += 1
    return number, json.loads(_read(spark, _file(uri, number))) if number >= 0 else None


def commit(spark, uri, number, state):
    """Put ``state`` down as commit ``number``; raises ``Conflict`` when that number is taken."""
    draft, final = f"{uri}/commits/draft-{uuid.uuid4().hex}", _file(uri, number)
    _write(spark, draft, json.dumps(state))
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(_at(spark, draft)[1].getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(fs.Path(draft), fs.Path(final), options)
    except Py4JJavaError as error:
        if exists(spark, final):
            raise Conflict(f"commit {number} of {uri} is taken") from error
        raise
    _write(spark, f"{uri}/commits/hint", str(number), overwrite=True)


def update(spark, uri, change, tries=50):
    """Commit ``change(state)``, from the newest state again as long as another writer is first."""
    for _ in range(tries):
        number, state = newest(spark, uri)
        state = change(state)
        try:
            commit(spark, uri, number + 1, state)
            return state
        except Conflict:
            continue
    raise Conflict(f"no commit after {tries} tries in {uri}")
