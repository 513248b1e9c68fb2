"""Source trees, build files, and what they say about a project."""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeseam.functions.fixed import BUILD_FILES, BUILD_SKIPPED_FOLDERS, BUILD_SYSTEMS, GENERATED_LAYOUTS, PROCESSOR_SERVICE, SKIPPED_FOLDERS, SKIPPED_PREFIX, SOURCE_LAYOUTS
from codeseam.sources.facts import SCHEMA, extract

#: A folder that a build writes generated sources to: any that stands where a layout has a star.
GENERATED = "(?<![^/])(?:" + "|".join(x.replace("*", "[^/]+") for x in GENERATED_LAYOUTS) + ")(?=/)"

FACTS = (
    "path string, package string, size bigint, md5 string, content string, physical int, blank int, comment int, code int, "
    + ", ".join(f"{name} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _fields)}>>" for name, _fields in ((n, re.split(r", (?![^<]*>)", d)) for n, d in SCHEMA.items()))
)


def _relative(root: str) -> Column:
    """Path below the root, whatever the scheme that a store puts in front of it."""
    bare = re.sub(r"^[a-z0-9+.-]+:/+", "/", root.rstrip("/"))
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/+", "/")
    return F.substring(path, F.instr(path, bare + "/") + len(bare) + 1, F.length(path))


def _kept(relative: Column, skipped: tuple[str, ...]) -> Column:
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    return ~F.exists(folders, lambda d: d.isin(*skipped) | F.startswith(d, F.lit(SKIPPED_PREFIX)))


def _found(spark: SparkSession, root: str, glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(root).withColumn("rel", _relative(root))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of the Java files below a root, a scan that prunes.

    Skipped folders are left out, but for the folders in them that builds write generated sources to.
    """
    files = _found(spark, root, "*.java").filter(_kept(F.col("rel"), SKIPPED_FOLDERS) | F.col("rel").rlike(GENERATED))
    return files.select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def build_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, content) of the build files below a root."""
    pattern = "{" + ",".join(BUILD_FILES) + "}"
    found = _found(spark, root, pattern).filter(_kept(F.col("rel"), BUILD_SKIPPED_FOLDERS))
    return found.select(F.col("rel").alias("path"), F.substring_index("rel", "/", -1).alias("name"), F.col("content").cast("string").alias("content"))


def jars(spark: SparkSession, root: str, below: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, md5, is_processor) of the jars below a root, one for each content: that of the least path.

    With ``below`` only jars somewhere in folders of these names count (``bazel-bin``, ``bazel-out``).  A processor jar
    registers annotation processors; a damaged jar registers none.
    """
    files = _found(spark, root, "*.jar")
    if below:
        files = files.filter(F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, below))))
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("md5", pa.string()), ("is_processor", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        own = PROCESSOR_SERVICE in z.namelist()
                except (zipfile.BadZipFile, ValueError, EOFError):
                    own = False
                for column, value in zip(out, (path, len(data), hashlib.md5(data).hexdigest(), own)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    found = files.select("rel", "content").mapInArrow(run, "path string, size bigint, md5 string, is_processor boolean")
    return found.groupBy("md5", "size").agg(F.min("path").alias("path"), F.max("is_processor").alias("is_processor")).select("path", "size", "md5", "is_processor")


def stamps(files: DataFrame) -> DataFrame:
    """(path, size, mtime, md5)."""
    return files.select("path", "size", "mtime", F.md5("content").alias("md5"))


def facts(files: DataFrame) -> DataFrame:
    """One row a file with its facts as arrays of structs.

    Rows leave Python as one JSON text each and are read by the JVM against a fixed schema.
    """
    schema = pa.schema([("facts", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [json.dumps(extract(p, c or b"")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], schema=schema)

    made = files.select("path", "content").mapInArrow(run, "facts string")
    return made.select(F.from_json("facts", FACTS).alias("f")).select("f.*")


def build_system(names: DataFrame) -> DataFrame:
    """(system): the first build system, in order, that one of the file names at the root belongs to; else UNKNOWN."""
    out = F.lit("UNKNOWN")
    for system, files in reversed(BUILD_SYSTEMS):
        out = F.when(F.max(F.col("name").isin(*files).cast("int")) == 1, system).otherwise(out)
    return names.agg(out.alias("system"))


def compliance(version: Column, newest: int = 25) -> Column:
    """A Java level: 1.x read as x, below 8 raised to 1.8, above the newest lowered to it, unreadable 1.8."""
    number = F.regexp_replace(version, r"^1\.", "").try_cast("int")
    return F.when(number.isNull() | (number <= 8), "1.8").when(number > newest, str(newest)).otherwise(number.cast("string"))


def source_root(path: Column) -> Column:
    """The source root that a file stands in: a standard layout's or a generated folder, else ``src``, else empty."""
    out = F.when(F.startswith(path, F.lit("src/")), F.lit("src")).otherwise(F.lit(""))
    out = F.when(path.rlike(GENERATED), F.regexp_extract(path, f"^(.*?{GENERATED})", 1)).otherwise(out)
    for layout in reversed(SOURCE_LAYOUTS):
        at = F.instr(F.concat(F.lit("/"), path), f"/{layout}/")
        out = F.when(at > 0, F.substring(path, F.lit(1), at + len(layout) - 1)).otherwise(out)
    return out


def maven_facts(pom: str) -> dict:
    """Modules, compiler level (properties, then the compiler plugin) and annotation-processor paths of a pom."""
    try:
        root = ET.fromstring(re.sub(r"""\sxmlns=(?:"[^"]*"|'[^']*')""", "", pom, count=1))
    except ET.ParseError as e:
        return {"modules": [], "level": None, "processors": [], "error": str(e)}
    text = lambda e: (e.text or "").strip() if e is not None else None
    props = {p.tag: text(p) for p in root.findall("properties/*")}
    level = next((props[k] for k in ("maven.compiler.release", "maven.compiler.source", "maven.compiler.target", "java.version") if props.get(k)), None)
    for plugin in root.iter("plugin"):
        if text(plugin.find("artifactId")) == "maven-compiler-plugin":
            level = level or next((v for k in ("release", "source", "target") if (v := text(plugin.find(f"configuration/{k}")))), None)
    if level and (m := re.fullmatch(r"\$\{(.+)\}", level)):
        level = props.get(m[1])
    paths = [f"{text(p.find('groupId'))}:{text(p.find('artifactId'))}" for p in root.iter("path") if p.find("artifactId") is not None]
    return {"modules": [text(m) for m in root.findall("modules/module")], "level": level, "processors": paths, "error": None}


def gradle_includes(settings: str) -> list[str]:
    """Project folders that a settings file includes."""
    out = []
    for m in re.finditer(r"\binclude\s*\(?([^\n)]*)", settings):
        out += [p.strip(":").replace(":", "/") for p in re.findall(r"[\"']([^\"']+)[\"']", m[1])]
    return list(dict.fromkeys(out))


def bazel_level(builds: list[str]) -> str | None:
    """The highest level that javacopts name."""
    found = [int(x) for b in builds for x in re.findall(r"(?:-source|-target|--release)[\"',\s=]+(?:1\.)?(\d+)", b)]
    return str(max(found)) if found else None


def maven_modules(files: dict[str, str], start: str = "pom.xml") -> list[str]:
    """Folders of all modules reachable from a pom, each once."""
    seen, todo = {}, [start]
    while todo:
        pom = todo.pop(0)
        if pom in seen or pom not in files:
            continue
        folder = str(PurePosixPath(pom).parent)
        seen[pom] = folder
        todo += [str(PurePosixPath(folder) / m / "pom.xml") for m in maven_facts(files[pom])["modules"]]
    return list(seen.values())
