"""Fixture relations as SQL that Spark and DuckDB both accept.

Every relation is derived from whole supplied tables.  ``with_ctes`` puts the
named relations, in dependency order, in front of a query body.
"""

from __future__ import annotations

LINE = "concat('m.x', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)"

# The facts of the graph, each with the table it is made from.  Facts of different
# entries are never equal.
FACTS = (
    ("nation", "SELECT concat('m.n', n_nationkey) AS subj, 'geo.nation.region' AS pred, concat('m.r', n_regionkey) AS obj, 'uri' AS obj_kind, '' AS obj_lang FROM nation"),
    ("customer", "SELECT concat('m.c', c_custkey), 'org.customer.nation', concat('m.n', c_nationkey), 'uri', '' FROM customer"),
    ("supplier", "SELECT concat('m.s', s_suppkey), 'org.supplier.nation', concat('m.n', s_nationkey), 'uri', '' FROM supplier"),
    ("orders", "SELECT concat('m.o', o_orderkey), 'sales.order.customer', concat('m.c', o_custkey), 'uri', '' FROM orders"),
    ("lineitem", f"SELECT concat('m.o', l_orderkey), 'sales.order.line', {LINE}, 'uri', '' FROM lineitem"),
    ("lineitem", f"SELECT {LINE}, 'sales.line.part', concat('m.p', l_partkey), 'uri', '' FROM lineitem"),
    ("lineitem", f"SELECT {LINE}, 'sales.line.supplier', concat('m.s', l_suppkey), 'uri', '' FROM lineitem"),
    ("part", "SELECT concat('m.p', p_partkey), 'catalog.part.brand', concat('g.b', replace(p_brand, 'Brand#', '')), 'uri', '' FROM part"),
    ("customer", "SELECT concat('m.c', c_custkey), 'org.customer.segment', c_mktsegment, 'literal', '' FROM customer"),
    ("orders", "SELECT concat('m.o', o_orderkey), 'sales.order.date', CAST(CAST(o_orderdate AS DATE) AS STRING), 'typed-literal', '' FROM orders"),
    ("region", "SELECT concat('m.r', r_regionkey), 'type.object.name', r_name, 'literal', 'en' FROM region"),
    ("nation", "SELECT concat('m.n', n_nationkey), 'type.object.name', n_name, 'literal', 'en' FROM nation"),
    ("nation", "SELECT concat('m.n', n_nationkey), 'type.object.name', lower(n_name), 'literal', 'fr' FROM nation"),
    ("customer", "SELECT concat('m.c', c_custkey), 'type.object.name', c_name, 'literal', 'en' FROM customer"),
    ("supplier", "SELECT concat('m.s', s_suppkey), 'type.object.name', s_name, 'literal', '' FROM supplier"),
    ("part", "SELECT concat('m.p', p_partkey), 'type.object.name', p_name, 'literal', 'en' FROM part"),
    ("part", "SELECT concat('g.b', replace(p_brand, 'Brand#', '')), 'type.object.name', p_brand, 'literal', 'en' FROM part"),
    ("customer", "SELECT concat('m.c', c_custkey), 'type.object.type', 'm.t_customer', 'uri', '' FROM customer"),
    ("nation", "SELECT concat('m.n', n_nationkey), 'common.topic.alias', concat('N', n_nationkey), 'literal', 'en' FROM nation"),
    ("part", "SELECT concat('m.p', p_partkey), 'freebase.valuenotation.is_reviewed', 'm.t_part', 'uri', '' FROM part"),
)
TRIPLES = """
SELECT DISTINCT subj, pred, obj, obj_kind, obj_lang FROM (
  """ + "\n  UNION ALL ".join(sql for _, sql in FACTS) + """
) t"""

KEY = ("CASE WHEN obj_kind = 'uri' THEN obj ELSE concat('\"', obj, '\"@', obj_lang, "
       "CASE WHEN obj_kind = 'typed-literal' THEN '^' ELSE '' END) END")

ADJ = f"""
SELECT subj AS node, TRUE AS fwd, pred, {KEY} AS nbr, obj AS nbr_value, obj_kind AS nbr_kind, obj_lang AS nbr_lang FROM triples
UNION ALL
SELECT {KEY}, FALSE, pred, subj, subj, 'uri', '' FROM triples"""

KG_LABELS = "SELECT subj AS id, obj AS label, obj_lang AS lang FROM triples WHERE pred = 'type.object.name'"

# Vocabulary of the fixture graph: predicate, property id, label, language.
RELATION_LABELS = """
SELECT pred, rel, label, lang FROM (VALUES
  ('geo.nation.region', 'P1', 'region of the nation', 'en'),
  ('org.customer.nation', 'P2', 'nation of the customer', 'en'),
  ('org.customer.nation', 'P2', 'Land des Kunden', 'de'),
  ('org.supplier.nation', 'P3', 'nation of the supplier', 'en'),
  ('sales.order.customer', 'P4', 'customer identifier', 'en'),
  ('sales.order.line', 'P5', 'line of the order', 'en'),
  ('sales.line.part', 'P6', 'part on the line', 'en'),
  ('sales.line.supplier', 'P7', 'Lieferant der Zeile', 'de'),
  ('catalog.part.brand', 'P8', 'logo image', 'en'),
  ('org.customer.segment', 'P9', 'market segment', 'en'),
  ('sales.order.date', 'P10', 'date of the order', 'en'),
  ('type.object.name', 'P11', 'name', 'en'),
  ('type.object.type', 'P373', 'type of thing', 'en'),
  ('common.topic.alias', 'P910', 'also known as', 'en'),
  ('freebase.valuenotation.is_reviewed', 'P14', '', 'en')
) AS v(pred, rel, label, lang)"""

# hops: number of relations from topic to answer; sig: the chain as text.
QUESTIONS = """
SELECT concat('qa-n', n_nationkey) AS qid, 'qa' AS family, CAST(n_nationkey AS BIGINT) AS k, concat('Which region is the nation ', n_name, ' in') AS question, concat('m.n', n_nationkey) AS topic_id, n_name AS topic_name, '->geo.nation.region' AS sig, 1 AS hops FROM nation
UNION ALL SELECT concat('qb-n', n_nationkey), 'qb', CAST(n_nationkey AS BIGINT), concat('Which customer belongs to the nation ', n_name), concat('m.n', n_nationkey), n_name, '<-org.customer.nation', 1 FROM nation
UNION ALL SELECT concat('qc-c', c_custkey), 'qc', c_custkey, concat('In which region is the nation of customer ', c_name), concat('m.c', c_custkey), c_name, '->org.customer.nation ->geo.nation.region', 2 FROM customer
UNION ALL SELECT concat('qd-p', p_partkey), 'qd', p_partkey, concat('From which nation is a supplier of a line with part ', p_name), concat('m.p', p_partkey), p_name, '<-sales.line.part ->sales.line.supplier ->org.supplier.nation', 3 FROM part
UNION ALL SELECT concat('qe-o', o_orderkey), 'qe', o_orderkey, concat('On which date was order number ', o_orderkey, ' placed'), concat('m.o', o_orderkey), concat('Order ', o_orderkey), '->sales.order.date', 1 FROM orders
UNION ALL SELECT concat('qf-p', p_partkey), 'qf', p_partkey, concat('Which brand carries the part ', p_name), concat('m.p', p_partkey), p_name, '->catalog.part.brand', 1 FROM part
UNION ALL SELECT concat('qg-n', n_nationkey), 'qg', CAST(n_nationkey AS BIGINT), concat('How many supplier firms has the nation ', n_name), concat('m.n', n_nationkey), n_name, '<-org.supplier.nation', 1 FROM nation"""

# Gold answers, one row each; counts and dates have no id.
GOLD = """
SELECT concat('qa-n', n_nationkey) AS qid, concat('m.r', r_regionkey) AS gid, r_name AS gname FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('qb-n', c_nationkey), concat('m.c', c_custkey), c_name FROM customer
UNION ALL SELECT concat('qc-c', c_custkey), concat('m.r', r_regionkey), r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT concat('qd-p', l_partkey), concat('m.n', n_nationkey), n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('qe-o', o_orderkey), '', CAST(CAST(o_orderdate AS DATE) AS STRING) FROM orders
UNION ALL SELECT concat('qf-p', p_partkey), concat('g.b', replace(p_brand, 'Brand#', '')), p_brand FROM part
UNION ALL SELECT concat('qg-n', n_nationkey), '', CAST(count(s_suppkey) AS STRING) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "triples": ((), TRIPLES),
    "adj": (("triples",), ADJ),
    "kg_labels": (("triples",), KG_LABELS),
    "relation_labels": ((), RELATION_LABELS),
    "questions": ((), QUESTIONS),
    "gold": ((), GOLD),
}


def define(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(names: str, body: str, given: tuple[str, ...] = ()) -> str:
    """``WITH`` clause for the space-separated relations, then ``body``.

    Relations in ``given`` exist as views already.  A body may go on with more
    relations of its own by starting with a comma.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name in given:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {head}\n{body}" if head else body
