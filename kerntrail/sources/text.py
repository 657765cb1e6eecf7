"""Readers and writers of text formats: xyz files, key-value comments, property lists, tables of files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "struct<symbol:string,x:double,y:double,z:double>"


def number(text: Column) -> Column:
    """A double, also from forms like 1.5*^-3; NULL where it is none."""
    return F.regexp_replace(text, r"\*\^", "e").try_cast("double")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.xyz") -> DataFrame:
    """(path, text): whole files of a folder."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_archives(spark: SparkSession, path: str, pattern: str = "*.tar*") -> DataFrame:
    """(path, member, text): the files in tar archives, an archive at a time in a task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as archive:
                    for member in archive:
                        if member.isfile():
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.record_batch([pa.array([name]), pa.array([member.name]), pa.array([text])], ["path", "member", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(members, "path string, member string, text string")


def bond_orders(text: Column, least: float = 0.5) -> Column:
    """Bonds array<struct<a, b, order>> with a < b from lines `a b order`: rounded orders, those under `least` left out."""
    words = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))
    one = F.transform(words, lambda w: F.struct(F.get(w, F.lit(0)).try_cast("int").alias("i"), F.get(w, F.lit(1)).try_cast("int").alias("j"), number(F.get(w, F.lit(2))).alias("o")))
    kept = F.filter(one, lambda x: x["i"].isNotNull() & x["j"].isNotNull() & (x["o"] >= least))
    return F.array_distinct(F.transform(kept, lambda x: F.struct(F.least(x["i"], x["j"]).alias("a"), F.greatest(x["i"], x["j"]).alias("b"), F.greatest(F.round(x["o"]), F.lit(1.0)).cast("int").alias("order"))))


def parse_xyz(text: Column) -> Column:
    """natoms, comment, atoms and the lines behind, of an xyz text; NULL numbers where a line is broken."""
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    n = F.trim(F.get(lines, F.lit(0))).try_cast("int")

    def atom(line: Column) -> Column:
        w = F.split(F.trim(line), r"\s+")
        return F.struct(F.get(w, F.lit(0)).alias("symbol"), *[number(F.get(w, F.lit(k))).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])

    atoms = F.transform(F.slice(lines, F.lit(3), F.coalesce(n, F.lit(0))), atom)
    return F.struct(n.alias("natoms"), F.get(lines, F.lit(1)).alias("comment"), atoms.alias("atoms"), F.slice(lines, F.coalesce(n, F.lit(0)) + 3, F.size(lines)).alias("rest"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.xyz") -> DataFrame:
    """(path) of a folder's files, in order; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path").orderBy("path")


def line_token(molecule: Column, behind: int) -> Column:
    """The first word of the line that stands `behind` lines behind the atoms of parse_xyz(...) (0: the next); NULL without one."""
    return F.nullif(F.get(F.split(F.trim(F.get(molecule["rest"], F.lit(behind))), r"\s+"), F.lit(0)), F.lit(""))


#: The places of quantities in a property line that starts with a mark and a number, both counted.
PROPERTIES = {"A": 3, "B": 4, "C": 5, "mu": 6, "alpha": 7, "homo": 8, "lumo": 9, "gap": 10, "R2": 11, "zpve": 12, "U0": 13, "U": 14, "H": 15, "G": 16, "Cv": 17}


def molecule_table(spark: SparkSession, path: str, energies: dict[str, float], mark: str = "gdb") -> DataFrame:
    """xyz files with a property line -> a table: path, text (first representation behind the frequencies), the properties, atomisation
    (U0 less the atoms' energies by symbol); of files with one representation the first in the order of paths stays."""
    files = read_texts(spark, path).withColumn("m", parse_xyz(F.col("text")))
    apart = F.aggregate("m.atoms", F.lit(0.0), lambda s, a: s + F.create_map(*[F.lit(x) for kv in energies.items() for x in kv])[a["symbol"]])
    rows = files.select("path", line_token(F.col("m"), 1).alias("representation"), *property_line(F.col("text"), mark, PROPERTIES), apart.alias("apart"))
    first = rows.groupBy("representation").agg(F.min("path").alias("path"))
    one = rows.join(first, ["representation", "path"], "left_semi")
    return one.select("path", "representation", *PROPERTIES, (F.col("U0") - F.col("apart")).alias("atomisation"))


#: Angular momenta by the letter of a shell.
MOMENTA = {"s": 0, "p": 1, "d": 2, "f": 3, "g": 4, "h": 5, "i": 6}


def orbital_label(label: Column) -> Column:
    """A label such as `0 C 2px` (or `0C 2px`) as struct<atom, shell, angular, orientation>."""
    kind = F.regexp_extract(label, r"(\S+)\s*$", 1)
    letter = F.regexp_extract(kind, r"^\d*([A-Za-z])", 1)
    table = F.create_map(*[F.lit(x) for kv in MOMENTA.items() for x in kv])
    return F.struct(
        F.regexp_extract(label, r"^\s*(\d+)", 1).try_cast("int").alias("atom"), F.regexp_extract(kind, r"^(\d*[A-Za-z])", 1).alias("shell"),
        table[F.lower(letter)].alias("angular"), F.regexp_extract(kind, r"^\d*[A-Za-z](.*)$", 1).alias("orientation"),
    )


def state_word(text: Column) -> Column:
    """A word such as `C:6,V:4,H:2` as struct<charge, valence, hydrogens>; NULL for what is missing."""
    part = lambda k: F.nullif(F.regexp_extract(text, rf"(?:^|,)\s*{k}:(\d+)", 1), F.lit("")).try_cast("int")
    return F.struct(part("C").alias("charge"), part("V").alias("valence"), part("H").alias("hydrogens"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path).select("path", parse_xyz(F.col("text")).alias("m")).select("path", "m.*")


def xyz_text(atoms: Column, comment: Column) -> Column:
    """The xyz text of atoms array<struct<symbol, x, y, z>>."""
    line = lambda a: F.format_string("%s %.8f %.8f %.8f", a["symbol"], a["x"], a["y"], a["z"])
    return F.concat_ws("\n", F.size(atoms).cast("string"), comment, F.array_join(F.transform(atoms, line), "\n"))


def write_xyz(molecules: DataFrame, path: str) -> None:
    """molecules(atoms, comment): one text file row for each, in as many files as there are partitions."""
    molecules.select(xyz_text(F.col("atoms"), F.col("comment")).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def key_values(comment: Column, pairs: str = " ", parts: str = "=") -> Column:
    """A map from a comment like `charge=1 spin=0`; words without a value are left out."""
    words = F.filter(F.split(F.trim(comment), rf"\Q{pairs}\E+"), lambda w: F.contains(w, F.lit(parts)))
    entry = lambda w: F.struct(F.substring_index(w, parts, 1).alias("k"), F.substr(w, F.length(F.substring_index(w, parts, 1)) + len(parts) + 1).alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(words, entry)))


def typed(values: Column, kinds: dict[str, str]) -> list[Column]:
    """Columns from a map of texts, cast; NULL where a key is missing or its text is no such value."""
    return [values[k].try_cast(kind).alias(k) for k, kind in kinds.items()]


def property_line(text: Column, mark: str, positions: dict[str, int]) -> list[Column]:
    """Doubles from the first line that starts with the mark, by position of the word (from 1)."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit(mark))), F.lit(0))
    words = F.split(F.trim(line), r"\s+")
    return [number(F.get(words, F.lit(k - 1))).alias(name) for name, k in positions.items()]


def greatest_of_first_numbers(lines: Column) -> Column:
    """The greatest number of the first line that holds numbers alone (such as a list of frequencies)."""
    words = lambda x: F.split(F.trim(x), r"\s+")
    numeric = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.exists(words(x), lambda w: number(w).isNull()))
    return F.array_max(F.transform(words(F.get(numeric, F.lit(0))), number))


def named_value(text: Column, name: str) -> Column:
    """The value of the first line `name : value`; NULL without one."""
    return number(F.nullif(F.regexp_extract(text, rf"(?m)^\s*\Q{name}\E\s*:\s*(\S+)", 1), F.lit("")))


def read_values(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(id, value) from by-product files."""
    return spark.read.schema("id string, value double").option("sep", separator).csv(path)


def write_values(rows: DataFrame, path: str, separator: str = " ") -> None:
    rows.select("id", "value").write.mode("overwrite").option("sep", separator).csv(path)


def join_files(values: DataFrame, files: DataFrame) -> DataFrame:
    """values(id, ...) with the one file of files(path, text) that is named <id>__...; the job fails for an id without one or with several."""
    named = files.withColumn("id", F.regexp_extract("path", r"([^/]+?)__[^/]*$", 1))
    counts = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    checked = values.join(counts, "id", "left").withColumn("n", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("not one file for "), F.col("id"))).cast("bigint")))
    return checked.filter("n = 1").drop("n").join(named, "id")


def matrix_log(entries: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Lines `i j value` in fixed scientific form."""
    return entries.select(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.format_string("%.8E", F.col(value))).alias("line"))


def parse_graph(text: Column) -> Column:
    """Atoms and bonds of a graph string like 6#3@1:6#3: charge, #hydrogens, @neighbours, atoms joined by colons."""
    words = F.split(text, ":")
    head = lambda w: F.get(F.split(w, "@"), F.lit(0))
    atom = lambda w: F.struct(F.get(F.split(head(w), "#"), F.lit(0)).cast("int").alias("z"), F.coalesce(F.get(F.split(head(w), "#"), F.lit(1)).cast("int"), F.lit(0)).alias("hydrogens"))
    ends = lambda w, i: F.transform(F.slice(F.split(w, "@"), 2, F.size(F.split(w, "@"))), lambda e: F.struct(F.least(i, e.cast("int")).alias("a"), F.greatest(i, e.cast("int")).alias("b")))
    return F.struct(F.transform(words, atom).alias("atoms"), F.array_distinct(F.flatten(F.transform(words, ends))).alias("bonds"))


def graph_text(atoms: Column, bonds: Column) -> Column:
    """The graph string of atoms array<struct<z, hydrogens>> and bonds array<struct<a, b>>; each bond stands at its first atom."""

    def word(a: Column, i: Column) -> Column:
        to = F.array_sort(F.transform(F.filter(bonds, lambda x: x["a"] == i), lambda x: x["b"]))
        hydrogens = F.when(a["hydrogens"] > 0, F.concat(F.lit("#"), a["hydrogens"].cast("string"))).otherwise("")
        return F.concat(a["z"].cast("string"), hydrogens, F.array_join(F.transform(to, lambda k: F.concat(F.lit("@"), k.cast("string"))), ""))

    return F.array_join(F.transform(atoms, word), ":")
