"""Writers of artifacts and results: staged and renamed as a whole, never over what is there."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.plans.bpe import token_bytes
from weft.plans.metadata import byte_alphabet


_ALPHABET = byte_alphabet()


def spelled(token: bytes) -> str:
    """A token's bytes in printable characters."""
    return "".join(_ALPHABET[b] for b in token)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _files(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return None
    return "".join(f"{r[0]}\n" for r in spark.read.text(path).collect())  # a report or a summary, never data


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all: written beside its place and renamed; an existing one is an error."""
    to, fs = _files(spark, path)
    if fs.exists(to):
        raise FileExistsError(path)
    beside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    _write(spark, beside, text)
    if not fs.rename(_files(spark, beside)[0], to):
        raise OSError(f"could not rename to {path}")


def _replace(spark: SparkSession, path: str, to: str) -> None:
    """A file in the place of another, in one step: whoever reads finds the old one or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, place = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).makeQualified(at).toUri(), conf)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at, place, how)


def commit(spark: SparkSession, staged: str, to: str, names: list[str]) -> None:
    """Moves staged files to their place if all of them are there; else none. Each is replaced in one step, an older one stays till then."""
    for name in names:
        at, fs = _files(spark, f"{staged}/{name}")
        if not fs.exists(at):
            raise FileNotFoundError(f"{staged}/{name}")
    for name in names:
        place, fs = _files(spark, f"{to}/{name}")
        fs.mkdirs(place.getParent())
        _replace(spark, f"{staged}/{name}", f"{to}/{name}")


def write_compositions(entries: DataFrame, path: str, groups: dict) -> None:
    """One composition document, which `corpus.compositions` reads: groups' names, values and sizes, and all entries, by token ids.

    Entries are as many as a vocabulary has, not as a corpus; keys come in order.
    """
    rows = entries.select(*sorted(entries.columns)).orderBy("token_ids").toJSON().collect()
    head = json.dumps({"version": 1, **groups}, sort_keys=True, ensure_ascii=False)
    write_whole(entries.sparkSession, path, f'{{"entries": [{", ".join(rows)}], {head[1:]}\n')


def merge_lines(spark: SparkSession, merges: list[tuple[str, str]], path: str) -> None:
    """Merge rules as a text file behind its version line."""
    write_whole(spark, path, "#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in merges))


def write_vocabulary(spark: SparkSession, merges: list[tuple[int, int]], folder: str) -> None:
    """vocab.json and merges.txt, tokens spelled in printable characters; both are read back, and must give the same rules.

    The rules are written as tokens; a reader that follows them makes the same ids.
    """
    tokens = [spelled(t) for t in token_bytes(merges)]
    write_whole(spark, f"{folder}/vocab.json", json.dumps({t: i for i, t in enumerate(tokens)}, ensure_ascii=False) + "\n")
    merge_lines(spark, [(tokens[a], tokens[b]) for a, b in merges], f"{folder}/merges.txt")
    if read_vocabulary(spark, folder) != merges:
        raise ValueError("the written vocabulary gives other rules")


def read_vocabulary(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """Rules of a vocab.json with its merges.txt; a rule of unknown tokens, or that makes another id than the vocabulary says, is an error."""
    known = json.loads(_read(spark, f"{folder}/vocab.json"))
    out = []
    for line in _read(spark, f"{folder}/merges.txt").splitlines():
        if line.startswith("#version") or not line.strip():
            continue
        a, b = line.split(" ")
        if a not in known or b not in known or known.get(a + b) != 256 + len(out):
            raise ValueError(f"the rule {line!r} doesn't fit the vocabulary")
        out.append((known[a], known[b]))
    return out


def write_task(spark: SparkSession, folder: str, task: str, result: dict) -> None:
    """A task's result as JSON, and a row of the summary beside it; a task that is there already is an error."""
    write_whole(spark, f"{folder}/{task}.json", json.dumps(result, sort_keys=True) + "\n")
    append_row(spark, f"{folder}/summary.csv", {"task": task, **result})


def append_row(spark: SparkSession, path: str, row: dict) -> None:
    """One more row of a small CSV summary, with a header if it is new."""
    before = _read(spark, path)
    out = io.StringIO()
    writer = csv.DictWriter(out, fieldnames=list(row), lineterminator="\n")
    if not before:
        writer.writeheader()
    writer.writerow(row)
    beside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    _write(spark, beside, (before or "") + out.getvalue())
    _replace(spark, beside, path)


def sections(title: str, parts: dict[str, list[tuple[str, object]]]) -> str:
    """A report in Markdown: a section for each part, sorted by name."""
    out = [f"# {title}\n"]
    for name in sorted(parts):
        out.append(f"\n## {name}\n\n" + "".join(f"- {k}: {v}\n" for k, v in parts[name]))
    return "".join(out)


def evaluation_csv(tasks: list[tuple[str, float, float]], core: float) -> str:
    """Task, accuracy and centred score of each task, and the composite, as text."""
    lines = ["Task,Accuracy,Centered"] + [f"{t},{a:.6f},{c:.6f}" for t, a, c in tasks] + [f"CORE,,{core:.6f}"]
    return "\n".join(lines) + "\n"
