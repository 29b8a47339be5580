"""N-Triples text to triple rows, by the grammar; lines it does not allow are kept apart.

Everything is a column expression.  Escaped pairs are first masked by two marks, so
the quote that ends a literal is the next quote, and all patterns are runs of
character classes: none backtracks or recurses, whatever the length of a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.terms import strip_entity_uri, strip_relation_uri
from kgloom.settings import GraphKind

_IRI = r'<[^<>"{}|^`\x00-\x20]*>'
_BLANK = r"_:[\p{L}\p{N}_:][\p{L}\p{M}\p{N}_:.\-\u00B7]*"
_FRONT = rf"(?s)^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI})[ \t]*(.*)$"
_NODE = rf"(?s)^({_IRI}|{_BLANK}(?<!\.))[ \t]*\.[ \t]*(?:#.*)?$"
_LITERAL = rf'(?s)^"[^"]*"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^({_IRI}))?[ \t]*\.[ \t]*(?:#.*)?$'
_IDLE = r"(?s)^[ \t]*(?:#.*)?$"
_HEX = "[0-9A-Fa-f]"
_PIECES = rf"(?:\\u{_HEX}{{4}})++|\\U{_HEX}{{8}}|\\.|[^\\]++"
_LONE = rf"\\u[Dd][89ABab]{_HEX}{{2}}(?!\\u[Dd][C-Fc-f])|(?<!\\u[Dd][89ABab]{_HEX}{{2}})\\u[Dd][C-Fc-f]{_HEX}{{2}}"
_OUTSIDE = rf"\\U(?!000[0-9A-Fa-f]{{5}}|0010{_HEX}{{4}})|\\U0000[Dd][89A-Fa-f]"
# The escapes of one letter.
_SIGNS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
MARKS = "\x01\x01"


@dataclass(frozen=True)
class TripleLoad:
    """A read dump: its triples, the lines that are none, and how many lines of each outcome there are."""

    triples: DataFrame       # subj, pred, obj, obj_kind (uri, bnode, literal, typed-literal), obj_lang
    quarantine: DataFrame    # file, line, reason (syntax, escape, code point)
    counts: DataFrame        # file, reason (empty for triples, idle for blank and comment lines), n_lines


def unescaped(text: Column) -> Column:
    """Escapes of N-Triples opened; text without a backslash passes as it is."""
    def opened(piece: Column) -> Column:
        plain = F.element_at(F.create_map(*[F.lit(x) for kv in _SIGNS.items() for x in kv]), F.substring(piece, 2, 1))
        return (
            F.when(~piece.startswith("\\"), piece)
            .when(piece.startswith("\\u"), F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
            .when(piece.startswith("\\U"), F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32"))
            .otherwise(plain))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECES), 0), opened)
    return F.when(text.contains("\\"), F.array_join(pieces, "")).otherwise(text)


def escape_fault(text: Column, numeric_only: Column | bool = False) -> Column:
    """Empty, ``escape`` for a backslash that opens no known escape, ``code point`` for one outside Unicode."""
    single = F.replace(text, F.lit("\\\\"), F.lit(""))           # escaped backslashes are no openers
    known = rf"\\(?![tbnrf\"'\\]|u{_HEX}{{4}}|U{_HEX}{{8}})"
    numeric = rf"\\(?!u{_HEX}{{4}}|U{_HEX}{{8}})"
    bad = F.when(F.lit(numeric_only), text.rlike(numeric)).otherwise(single.rlike(known))
    return F.when(~text.contains("\\"), "").when(bad, "escape").when(
        single.rlike(_LONE) | single.rlike(_OUTSIDE), "code point").otherwise("")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with subj, pred, obj, obj_kind, obj_lang and ``reason``: empty for a triple, ``idle`` for a blank or comment line.

    ``reason`` passes a generator: a filter on it stays above, where it would otherwise
    be pushed to the scan with every pattern written out each time it is used.
    """
    def bare(term: Column) -> Column:
        return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(term)

    rest, masked, front = F.col("_rest"), F.col("_masked"), F.col("_front")
    # One match gives all parts: no part but the last can hold a line feed, so a line that fits is changed.
    split = lines.withColumn("_front", F.regexp_replace(line, _FRONT, "$1\n$2\n$3"))
    split = split.withColumn("_front", F.when(front != F.col(line), F.split(front, "\n", 3)).otherwise(F.array(F.lit(""), F.lit(""), F.lit(""))))
    split = split.withColumns({"_s": front[0], "_p": front[1], "_rest": front[2]})
    split = split.withColumn("_masked", F.when(rest.contains("\\"), F.regexp_replace("_rest", r"(?s)\\.", MARKS)).otherwise(rest))
    quoted, marked = masked.startswith('"'), masked.contains('"@') | masked.contains('"^^')
    split = split.withColumn("_node", F.when(quoted, "").otherwise(F.regexp_extract(rest, _NODE, 1)))
    cut = split.withColumns({
        "_o": F.when(quoted, F.substring(rest, F.lit(2), F.locate('"', masked, 2) - 2)).otherwise(bare(F.col("_node"))),
        "_type": F.when(quoted & marked, F.regexp_extract(masked, _LITERAL, 2)).otherwise(""),
        "_lang": F.when(quoted & marked, F.regexp_extract(masked, _LITERAL, 1)).otherwise(""),
        "_fits": (F.col("_s") != "") & (F.col("_p") != "") & F.when(quoted, masked.rlike(_LITERAL)).otherwise(F.col("_node") != ""),
        "_s": bare(F.col("_s")), "_p": bare(F.col("_p")),
    })
    faults = [escape_fault(F.col(c), n) for c, n in (("_s", True), ("_p", True))] + [
        F.when(masked.startswith('"'), escape_fault(F.col("_o"))).otherwise(escape_fault(F.col("_o"), True))]
    fault = F.when(F.col(line).contains("\\"), F.coalesce(*[F.nullif(f, F.lit("")) for f in faults], F.lit(""))).otherwise("")
    reason = F.when(F.col("_fits"), fault).when(F.col(line).rlike(_IDLE), "idle").otherwise("syntax")
    judged = cut.select("*", F.inline(F.array(F.struct(reason.alias("reason")))))
    good = F.col("reason") == ""
    kind = F.when(masked.startswith('"'), F.when(F.col("_type") != "", "typed-literal").otherwise("literal")).when(
        F.col("_o").startswith("_:"), "bnode").otherwise("uri")
    return judged.select(
        *lines.columns, F.when(good, unescaped(F.col("_s"))).alias("subj"), F.when(good, unescaped(F.col("_p"))).alias("pred"),
        F.when(good, unescaped(F.col("_o"))).alias("obj"), F.when(good, kind).alias("obj_kind"),
        F.when(good, F.lower("_lang")).alias("obj_lang"), "reason")


def normalized_ids(triples: DataFrame, kind: GraphKind) -> DataFrame:
    """URIs of the graph's own name spaces shortened to ids; relations without an id go."""
    uri = F.col("obj_kind") == "uri"
    return triples.withColumns({
        "subj": strip_entity_uri(F.col("subj"), kind), "pred": strip_relation_uri(F.col("pred"), kind),
        "obj": F.when(uri, strip_entity_uri(F.col("obj"), kind)).otherwise(F.col("obj"))}).where("pred is not null")


def load_triples(spark: SparkSession, path: str, kind: GraphKind | None = None) -> TripleLoad:
    """A dump in N-Triples, split by Spark at lines; with ``kind`` its ids are normalized.

    Blank nodes keep their label: the files of one dump share it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = parse_lines(lines)
    triples = parsed.where("reason = ''").select("subj", "pred", "obj", "obj_kind", "obj_lang")
    return TripleLoad(
        (triples if kind is None else normalized_ids(triples, kind)).distinct(),
        parsed.where("reason not in ('', 'idle')").select("file", F.col("value").alias("line"), "reason"),
        parsed.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n_lines")))
