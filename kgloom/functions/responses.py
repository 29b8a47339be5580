"""Reading model replies with Spark's JSON functions, whole tables at a time.

A reply is parsed as ``map<string,string>`` or ``array<string>``: nested values
stay JSON text until a field needs them.  Unreadable replies give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LAX = {"allowSingleQuotes": "true"}
DECISIONS = ("forward", "backtrack", "constraint", "filter", "stop", "yes", "no")
ACTIONS = {"stop": "Stop", "yes": "Stop", "forward": "Forward", "no": "Forward",
           "constraint": "Constraint", "filter": "Constraint", "backtrack": "Backtrack"}


def _map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", _LAX)


def _list(text: Column) -> Column:
    return F.from_json(text, "array<string>", _LAX)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _valid(text: Column) -> Column:
    """One whole JSON value.  The parser ignores text after a value, so the
    text is wrapped in a list, which then must have exactly one element."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "string").isNull()


def _is(text: Column, left: str, right: str) -> Column:
    """Well-formed JSON of one kind, or the same written with single quotes."""
    framed = text.startswith(left) & text.endswith(right)
    strict = _valid(text)
    quoted = ~text.contains('"') & _valid(F.translate(text, "'", '"'))
    return framed & (strict | quoted)


def _candidates(text: Column, span: str) -> Column:
    fenced = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```"), 1)
    spans = F.regexp_extract_all(text, F.lit(span), 0)
    return F.concat(F.array(F.trim(text)), F.transform(fenced, lambda x: F.trim(x)), spans)


def extract_json_object(text: Column, greedy: bool = False) -> Column:
    """First readable object: whole text, fenced block, then brace span."""
    span = r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}"
    found = F.filter(_candidates(text, span), lambda c: _is(c, "{", "}"))
    return _map(F.get(found, F.lit(0)))


def extract_json_list(text: Column, span: bool = True) -> Column:
    """First readable list as trimmed, non-blank texts."""
    found = F.filter(_candidates(text, r"(?s)\[.*\]") if span else _candidates(text, r"(?s)^\[.*\]$"),
                     lambda c: _is(c, "[", "]"))
    return non_blank(_list(F.get(found, F.lit(0))))


def non_blank(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def list_field(value: Column) -> Column:
    """A field's list of non-blank texts; empty if the field is no list."""
    return F.when(value.startswith("["), non_blank(_list(value))).otherwise(F.array().cast("array<string>"))


def first_nonempty_attempt(responses: DataFrame, attempts: int = 3) -> DataFrame:
    """First attempt with text per prompt, with its usage; empties remain NULL."""
    usable = (F.col("attempt") <= attempts) & (F.length(F.coalesce("text", F.lit(""))) > 0)
    value = F.struct("text", "input_tokens", "output_tokens")
    best = F.min_by(F.when(usable, value), F.when(usable, F.col("attempt"))).alias("b")
    return responses.groupBy("prompt_key").agg(best).select("prompt_key", "b.text", "b.input_tokens", "b.output_tokens")


def parse_relation_ranking(text: Column) -> Column:
    """Ranked relations of a reply: array<struct<pos,text,rank,score>>."""
    none = F.lit(None).cast("string")

    def entry(t, rank, score):
        return F.struct(F.trim(t).alias("text"), rank.cast("string").alias("rank"), score.cast("string").alias("score"))

    def present(items):
        return F.filter(items, lambda e: e["text"].isNotNull() & (e["text"] != ""))

    def object_name(m):
        return F.coalesce(m["relation"], m["relation_id"], m["id"])

    def by_relevance(f):
        def item(x, i):
            name = (F.when(x.startswith("["), F.get(_list(x), F.lit(0)))
                    .when(x.startswith("{"), let(_map(x), object_name)).otherwise(x))
            return entry(name, none, F.get(f["scores"], i))

        return F.when(f["ranked"].startswith("["), present(F.transform(_list(f["ranked"]), item))).otherwise(
            present(F.array(entry(f["ranked"], none, F.get(f["scores"], F.lit(0))))))

    def from_object(m):
        fields = F.struct(m["relation_by_relevance"].alias("ranked"), _list(m["relevance_score"]).alias("scores"))
        keys = F.transform(F.map_keys(m), lambda k: entry(k, none, none))
        return let(let(fields, by_relevance), lambda found: F.when(F.size(found) > 0, found).otherwise(keys))

    def from_row(m):
        lone = (F.size(m) == 1) | ((F.size(m) == 2) & F.map_contains_key(m, F.lit("rank")))
        other = F.get(F.filter(F.map_keys(m), lambda k: k != "rank"), F.lit(0))
        name = F.coalesce(m["relation_id"], m["relation"], F.when(lone, other))
        return entry(name, m["rank"], F.coalesce(m["score"], m["relevance_score"]))

    def from_list(items):
        rows = F.filter(items, lambda x: x.startswith("{"))
        return present(F.transform(F.transform(rows, _map), from_row))

    def read(payload):
        good = _valid(payload)
        return F.when(good & payload.startswith("{"), let(_map(payload), from_object)).when(
            good & payload.startswith("["), from_list(_list(payload)))

    def payload_of(t):
        inner = F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")),
                           F.regexp_extract(t, r"(?s)\[.*\]", 0))
        return F.when(t.startswith("[") | t.startswith("{"), t).otherwise(inner)

    return F.transform(let(let(F.trim(text), payload_of), read), lambda e, i: F.struct(
        i.alias("pos"), e["text"].alias("text"), e["rank"].alias("rank"), e["score"].alias("score")))


def parse_reasoning_decision(text: Column) -> Column:
    """struct<decision, answers>: decision in the closed set, else NULL."""
    def read(obj):
        decision = F.lower(F.trim(obj["decision"]))
        return F.struct(F.when(decision.isin(*DECISIONS), decision).alias("decision"),
                        list_field(obj["answer"]).alias("answers"))

    return let(extract_json_object(text), read)


def parse_yes_no(text: Column) -> Column:
    """struct<decision, answers, warning> of a sufficiency check."""
    def read(obj):
        decision = F.lower(F.trim(obj["decision"]))
        valid = F.coalesce(decision.isin("yes", "no"), F.lit(False))
        return F.struct(
            F.when(valid, decision).alias("decision"), list_field(obj["answer"]).alias("answers"),
            F.when(obj.isNull(), "unreadable").when(~valid, "no decision").otherwise("").alias("warning"))

    return let(extract_json_object(text), read)


def decision_to_action(decision: Column) -> Column:
    key = F.lower(F.trim(decision))
    mapping = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, key), F.lit("UnknownAction"))


def parse_answer_list(text: Column) -> Column:
    """Answers joined by ", " of a strict reply; else the text in braces."""
    whole = F.trim(text)
    obj = F.when(whole.startswith("{") & _valid(whole), _map(whole))
    value = obj["answer"]
    strict = F.when(obj.isNotNull() & value.isNull(), F.lit("")).when(
        value.startswith("["), F.array_join(list_field(value), ", "))
    open_, close = F.locate("{", text), F.locate("}", text)
    legacy = F.when((open_ > 0) & (close > open_), F.trim(F.substring(text, open_ + 1, close - open_ - 1)))
    return F.coalesce(strict, legacy, F.lit(""))


def to_bool(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1"), True).when(v.isin("false", "no", "0"), False)


def line_fields(text: Column, names: dict[str, str]) -> Column:
    """``key: value`` lines as a map; ``names`` maps line prefix to field."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    def value_of(prefix):
        def begins(x):
            return (x if prefix.isupper() else F.lower(x)).startswith(prefix + ":")

        hits = F.filter(lines, begins)
        return F.trim(F.substring(F.get(hits, F.size(hits) - 1), len(prefix) + 2, 1 << 20))

    entries = [c for prefix, field in names.items() for c in (F.lit(field), value_of(prefix))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def answer_text(value: Column) -> Column:
    items = non_blank(_list(value))
    return F.nullif(F.when(value.startswith("["), F.array_join(items, ", ")).otherwise(F.trim(value)), F.lit(""))


def parse_sufficiency(text: Column) -> Column:
    """struct<sufficient, answer, retrieve_entity, reason> of a judgement."""
    obj = F.coalesce(
        extract_json_object(text, greedy=True),
        line_fields(text, {"A": "A", "R": "R", "sufficient": "Sufficient", "answer": "Answer", "reason": "Reason"}))
    def read(obj):
        a, r = obj["A"], F.trim(obj["R"])
        nested = F.when(a.startswith("{"), _map(a))
        is_nested = nested.isNotNull()
        answer = answer_text(F.when(is_nested, nested["Answer"]).otherwise(obj["Answer"]))
        reason0 = F.coalesce(F.trim(obj["Reason"]), F.lit(""))
        long_r = (reason0 == "") & (F.size(F.filter(F.split(r, r"\s+"), lambda w: w != "")) >= 4)
        action = F.lower(F.trim(a)).isin("answer", "a")
        stated = to_bool(F.when(is_nested, nested["Sufficient"]).otherwise(obj["Sufficient"]))
        given = F.coalesce(stated, F.coalesce(action & ~is_nested, F.lit(False)))
        veto = F.lower(answer).isin("null", "none") | answer.startswith("m.") | answer.startswith("['m.") | answer.startswith('["m.')
        return F.struct(
            (given & ~F.coalesce(veto, F.lit(False))).alias("sufficient"), answer.alias("answer"),
            F.when(~is_nested & ~long_r, F.nullif(r, F.lit(""))).alias("retrieve_entity"),
            F.when(is_nested, F.coalesce(r, F.lit(""))).when(F.coalesce(long_r, F.lit(False)), r).otherwise(reason0).alias("reason"))

    return let(obj, read)


def parse_reverse_decision(text: Column) -> Column:
    """struct<need_reverse, names, reason>; default is no re-visit."""
    obj = F.coalesce(extract_json_object(text, greedy=True),
                     line_fields(text, {k: k for k in ("need_reverse", "reverse_entity_names", "reason")}))
    def read(obj):
        raw = obj["reverse_entity_names"]
        names = F.when(raw.startswith("["), non_blank(_list(raw))).otherwise(non_blank(F.split(raw, r"[,;\n]")))
        return F.struct(F.coalesce(to_bool(obj["need_reverse"]), F.lit(False)).alias("need_reverse"),
                        F.coalesce(names, F.array().cast("array<string>")).alias("names"),
                        F.coalesce(F.trim(obj["reason"]), F.lit("")).alias("reason"))

    return let(obj, read)


def parse_subquestions(text: Column) -> Column:
    """A list, or a bracketed span, or lines without bullets."""
    lines = F.transform(F.split(F.trim(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[-• \t]+|[-• \t]+$", ""))
    return F.coalesce(extract_json_list(text), F.filter(lines, lambda x: x != ""))


def parse_memory(text: Column) -> Column:
    """First object as canonical JSON text; NULL when there is none."""
    obj = extract_json_object(text, greedy=True)
    return F.when(F.size(obj) > 0, F.to_json(obj))


def split_answer_text(text: Column) -> Column:
    """JSON list; bracketed text cut at commas; else one answer."""
    t = F.trim(text)
    strict = F.when(t.startswith("[") & _valid(t), non_blank(_list(t)))
    cut = F.filter(F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), ","),
                               lambda x: F.regexp_replace(F.trim(x), "^\"+|\"+$|^\"*'+|'+\"*$", "")), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(strict, F.when(t.startswith("[") & t.endswith("]"), cut), F.array(t)))


def parse_quality_report(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("step", "parse_status").agg(F.count(F.lit(1)).alias("n"))
