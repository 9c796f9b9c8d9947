"""Facts from program texts, with patterns rather than a parser: packages, imports, types, public methods; and what is made of call graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.text import owner
from seamline.operators import java
from seamline.operators.filters import is_stored_entity


def bare(c: Column) -> Column:
    """A program text without comments; string literals stay, as a comment sign in one doesn't open a comment."""
    return F.regexp_replace(c, r'("(?:[^"\\\n]|\\.)*+")|/\*(?s:.*?)\*/|//[^\n]*', "$1")


def public_methods(files: DataFrame) -> DataFrame:
    """path, k, name: public methods in order, each once, without main. files: path, text.

    What stands between `public` and the first parenthesis, without type arguments, is looked at word by word: the last one is the name, and a type must stand before it.
    """
    heads = F.regexp_extract_all(bare(F.col("text")), F.lit(r"(?m)^\s*public\s([^(){};=]*)\("), F.lit(1))
    plain = lambda h: F.regexp_replace(F.regexp_replace(h, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", " "), r"[\[\],]", " ")
    words = F.transform(heads, lambda h: F.filter(F.split(plain(h), r"\s+"), lambda w: w != ""))
    is_method = lambda w: (F.size(w) > 1) & ~F.arrays_overlap(w, F.array(*map(F.lit, ("class", "interface", "enum")))) & F.element_at(w, -1).rlike(r"^[A-Za-z_]\w*$")
    names = F.array_distinct(F.filter(F.transform(F.filter(words, is_method), lambda w: F.element_at(w, -1)), lambda n: n != "main"))
    return files.select("path", F.posexplode(names).alias("k", "name"))


def types(files: DataFrame) -> DataFrame:
    """path, fqcn, kind, bases: the first type of each file; bases are the simple names it extends or implements."""
    text = bare(F.col("text"))
    pkg = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    head = r"\b(class|interface|enum)\s+(\w+)([^{]*)\{"
    kind, name, rest = (F.regexp_extract(text, head, k) for k in (1, 2, 3))
    plain = F.regexp_replace(F.regexp_replace(rest, r"<[^<>]*(<[^<>]*>)*[^<>]*>", ""), r"\b(extends|implements|permits)\b", ",")
    bases = F.filter(F.transform(F.split(plain, ","), lambda b: F.trim(b)), lambda b: b != "")
    fqcn = F.when(pkg != "", F.concat_ws(".", pkg, name)).otherwise(name)
    return files.select("path", fqcn.alias("fqcn"), kind.alias("kind"), bases.alias("bases")).where("kind <> ''")


def imports(files: DataFrame) -> DataFrame:
    """source, target: imports of each file's first type; star imports name no class and are left out."""
    found = F.regexp_extract_all(bare(F.col("text")), F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))
    edges = files.select("path", F.explode(found).alias("target"))
    return edges.join(types(files).select("path", F.col("fqcn").alias("source")), "path").select("source", "target")


def hierarchy(files: DataFrame) -> DataFrame:
    """source, target: each type and the types of its own package that it extends or implements."""
    t = types(files)
    base = t.select(F.col("fqcn").alias("source"), F.explode("bases").alias("b"))
    named = base.select("source", F.concat(F.when(F.instr("source", ".") > 0, F.concat(owner(F.col("source")), F.lit("."))).otherwise(F.lit("")), "b").alias("target"))
    return named.join(t.select(F.col("fqcn").alias("target")).distinct(), "target").select("source", "target").distinct()


def class_calls(calls: DataFrame) -> DataFrame:
    """i, j: classes that call each other either way. calls: source, target (methods)."""
    a, b = owner(F.col("source")), owner(F.col("target"))
    return calls.where(a != b).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).distinct()


def class_entities(calls: DataFrame) -> DataFrame:
    """n, entity: classes and the entities they touch; calls between two entities or none don't count."""
    x = calls.select(owner(F.col("source")).alias("s"), owner(F.col("target")).alias("t")).withColumn("a", is_stored_entity(F.col("s"))).withColumn("b", is_stored_entity(F.col("t")))
    return x.where("a <> b").select(F.when(F.col("a"), F.col("t")).otherwise(F.col("s")).alias("n"), F.when(F.col("a"), F.col("s")).otherwise(F.col("t")).alias("entity")).distinct()


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def package_summary(names: DataFrame) -> DataFrame:
    """pkg, n, members (simple names in order) of each package. names: fqcn."""
    from seamline.functions.text import package, simple_name

    c = F.col("fqcn")
    return names.select(package(c).alias("pkg"), simple_name(c).alias("s")).groupBy("pkg").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("s")).alias("members"))


def prompt(system: str, packages: DataFrame, k: int) -> DataFrame:
    """One row: the text that asks for k services, from package summaries."""
    line = F.concat(F.lit("- "), "pkg", F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("members", ", "))
    body = packages.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    return body.select(F.concat(F.lit(f"Group the classes of {system} into {k} services.\n"), "b").alias("prompt"))


def inverted(services: DataFrame) -> DataFrame:
    """n, cluster: classes by service, from service, classes (array); a class of several services belongs to the first by name."""
    return services.select("service", F.explode("classes").alias("n")).groupBy("n").agg(F.min("service").alias("cluster"))


def assembled_prompt(system: str, packages: DataFrame, classes: DataFrame, low: int, high: int) -> DataFrame:
    """One row: the text that asks for `low` to `high` services, from summaries of packages (pkg, n, members) and classes (n, keywords array)."""
    line = F.concat(F.lit("- "), "pkg", F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("members", ", "))
    words = F.concat(F.lit("- "), "n", F.lit(": "), F.array_join("keywords", ", "))
    gathered = lambda df, c, name: df.agg(F.array_join(F.sort_array(F.collect_list(c)), "\n").alias(name))  # noqa: E731  a prompt is one text
    both = gathered(packages, line, "p").join(F.broadcast(gathered(classes, words, "c")))  # one row each
    return both.select(F.concat(F.lit(f"Group the classes of {system} into {low} to {high} services.\nAnswer with JSON: service to list of classes.\n\nPackages:\n"), "p", F.lit("\n\nClasses:\n"), "c").alias("prompt"))


def methods(files: DataFrame) -> DataFrame:
    """path, fqcn, name, first, last, text: methods of all types of each file, nested ones too, by a lexer that knows literals and comments; a name that comes again has its own lines. files: path, text."""
    found = java.declarations(files).where("kind = 'method'")
    return found.select("path", F.col("type").alias("fqcn"), "name", "first", "last", "text").dropDuplicates(["fqcn", "name", "first", "last"])


def call_edges(found: DataFrame) -> DataFrame:
    """source, target: methods (fqcn.name) that call a method's name which one class alone has, or else the caller's own class; other calls have no sure target and are left out. found: fqcn, name, text."""
    called = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", r"^[^(]*", ""), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    calls = found.select("fqcn", F.concat_ws(".", "fqcn", "name").alias("source"), F.explode(called).alias("name")).distinct()
    owners = found.select("fqcn", "name").distinct().groupBy("name").agg(F.min("fqcn").alias("only"), F.count("*").alias("k"))
    own = found.select("fqcn", "name", F.lit(True).alias("own")).distinct()
    target = F.when(F.col("own"), F.concat_ws(".", "fqcn", "name")).when(F.col("k") == 1, F.concat_ws(".", "only", "name"))
    return calls.join(owners, "name").join(own, ["fqcn", "name"], "left").select("source", target.alias("target")).where("target is not null and target <> source").distinct()


def source_roots(files: DataFrame) -> DataFrame:
    """root, n: folders below which program files lie by their packages, and how many do. files: path, text. A file whose folder isn't that of its package has its own folder as root."""
    pkg = F.regexp_extract(bare(F.col("text")), r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    below = F.concat(F.lit("/"), F.replace(pkg, F.lit("."), F.lit("/")))
    root = F.when((pkg != "") & F.endswith(folder, below), F.substr(folder, F.lit(1), F.length(folder) - F.length(below))).otherwise(folder)
    return files.select(root.alias("root")).groupBy("root").agg(F.count("*").alias("n"))


def outline(files: DataFrame) -> DataFrame:
    """path, outline: JSON of each file's first type, its kind and bases, imports and public methods. files: path, text."""
    listed = lambda df, c, name: df.groupBy("path").agg(F.sort_array(F.collect_set(c)).alias(name))
    found = F.regexp_extract_all(bare(F.col("text")), F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))
    own = types(files).join(files.select("path", F.array_sort(F.array_distinct(found)).alias("imports")), "path").join(listed(public_methods(files), "name", "methods"), "path", "left")
    none = F.array().cast("array<string>")
    return own.select("path", F.to_json(F.struct("fqcn", "kind", "bases", F.coalesce("imports", none).alias("imports"), F.coalesce("methods", none).alias("methods"))).alias("outline"))
