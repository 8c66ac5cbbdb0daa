"""Independent DuckDB SQL for every registered query.

Mining is checked by enumerating every subset of every basket (recursive
CTE), which shares nothing with FP-growth; co-occurrence by a plain self-join;
histograms by the same placement rule written in SQL. Views ``lineitem``,
``part``, ``events`` … are registered by the caller.
"""

from __future__ import annotations

from trolley.plans.catalog import (
    CHUNK_WIDTH,
    DEFAULTS_SPEC,
    EVENT_SPEC,
    EXPLORE_MIN_LIFT,
    EXPLORE_MIN_SUPPORT,
    EXPLORE_NEEDLE,
    NAME_SPEC,
    SEARCH_NEEDLE,
    SWEEP_SETTINGS,
    TYPE_SPEC,
)
from trolley.plans.study import DEFAULT_SPEC

SUPPORT = DEFAULT_SPEC.min_support
CONFIDENCE = DEFAULT_SPEC.min_confidence

ORDER_BRANDS = """
  select distinct l_orderkey as b, lower(trim(p_brand)) as i
  from lineitem join part on l_partkey = p_partkey
  where p_brand is not null"""

ORDER_TYPES = """
  select distinct l_orderkey as b, lower(trim(p_type)) as i
  from lineitem join part on l_partkey = p_partkey
  where p_type is not null"""

ORDER_NAMES = """
  select distinct l_orderkey as b, lower(trim(p_name)) as i
  from lineitem join part on l_partkey = p_partkey
  where p_name is not null"""

USER_EVENTS = """
  select distinct user_id as b, lower(trim(event_type)) as i
  from events
  where event_type is not null"""


def _baskets(lines: str) -> str:
    return f"""
li as ({lines}),
ok as (select b from li group by b having count(*) > 1),
x as (select li.b, li.i from li join ok using (b)),
n as (select count(*)::double as n from ok)"""


BASKETS = _baskets(ORDER_BRANDS)

SUBSETS = """
sub(b, items, last) as (
  select b, [i], i from x
  union all
  select sub.b, list_append(sub.items, x.i), x.i
  from sub join x on x.b = sub.b and x.i > sub.last)"""


def _mined_cte(support: float, confidence: float) -> str:
    return f"""
fi as (
  select items, count(*) as freq from sub group by items
  having count(*) >= (select ceil({support}::double * n) from n)),
c as (select items as u, freq as fu, unnest(items) as cons from fi where len(items) > 1),
r as (select list_filter(u, lambda z: z <> cons) as a, [cons] as k, fu from c),
rules as (
  select r.a, r.k,
         r.fu / fa.freq::double as confidence,
         (r.fu / fa.freq::double) / (fk.freq / n.n) as lift,
         r.fu / n.n as support
  from r join fi fa on fa.items = r.a join fi fk on fk.items = r.k cross join n
  where r.fu / fa.freq::double >= {confidence}::double),
rl as (
  select array_to_string(a, ', ') as antecedent, array_to_string(k, ', ') as consequent,
         confidence, lift, support
  from rules)"""


MINED = _mined_cte(SUPPORT, CONFIDENCE)

ITEMS = """
ic as (select i as item, count(*) as cnt from x group by i)"""

def _top_items(n: int) -> str:
    return f"""
top as (
  select item, cnt, row_number() over (order by cnt desc, item) - 1 as pos
  from ic order by cnt desc, item limit {n}),
tx as (select x.b, x.i from x join top on x.i = top.item),
pc as (
  select a.i as i1, b.i as i2, count(*) as n
  from tx a join tx b on a.b = b.b and a.i <> b.i group by 1, 2)"""


TOP10 = _top_items(10)


def _cooccurrence(n: int) -> str:
    return _with(BASKETS, ITEMS, _top_items(n)) + """
select t1.item as item_1, t2.item as item_2, coalesce(pc.n, 0)::bigint as n
from top t1 cross join top t2 left join pc on pc.i1 = t1.item and pc.i2 = t2.item"""


def _with(*parts: str, recursive: bool = False) -> str:
    head = "with recursive" if recursive else "with"
    return head + ",".join(parts) + "\n"


def _mined(*extra: str) -> str:
    return _with(BASKETS, SUBSETS, MINED, *extra, recursive=True)


def _other(lines: str, support: float, confidence: float) -> str:
    return _with(_baskets(lines), SUBSETS, _mined_cte(support, confidence), recursive=True)


ITEMSETS_SELECT = "select array_to_string(items, ', ') as items, len(items)::bigint as size, freq::bigint as freq from fi"
RULES_SELECT = "select antecedent, consequent, confidence, lift, support from rl"


def _ordered_rules(limit: int) -> str:
    return f"""
tr as (
  select * from rl
  order by lift desc nulls last, antecedent, consequent
  limit {limit})"""


def _graph_edges(r: int) -> str:
    return _mined(
        _ordered_rules(r),
        """
span as (select coalesce(min(confidence), 0.0::double) as lo, coalesce(max(confidence), 1.0::double) as hi from tr),
e as (
  select tr.*, case when hi - lo > 0 then (confidence - lo) / (hi - lo) else 0.5::double end as norm
  from tr cross join span)""",
    ) + """
select antecedent as src, consequent as dst, lift as weight, confidence, support,
       norm as norm_confidence, floor(norm * 10)::int as colour_bucket, lift * 2.5::double as width,
       printf('%s → %s<br>Lift: %.2f<br>Confidence: %.2f<br>Support: %.3f', antecedent, consequent, lift, confidence, support) as hover
from e"""


def _histogram(measure: str, bins: int = 20) -> str:
    return _mined(
        f"""
bd as (
  select case when max({measure}) > min({measure}) then min({measure}) else min({measure}) - 0.5 end as lo,
         case when max({measure}) > min({measure}) then max({measure}) else max({measure}) + 0.5 end as hi,
         count({measure}) as cnt
  from rl),
v as (select {measure} as v from rl where {measure} is not null),
p0 as (
  select v, least(floor((v - lo) * ({bins}.0::double / (hi - lo)))::int, {bins - 1}) as f, lo, hi
  from v cross join bd),
p1 as (
  select v, lo, hi,
         case when v < (case when f >= {bins} then hi else f::double * ((hi - lo) / {bins}.0::double) + lo end)
              then f - 1 else f end as d
  from p0),
p2 as (
  select case when v >= (case when d + 1 >= {bins} then hi else (d + 1)::double * ((hi - lo) / {bins}.0::double) + lo end)
                   and d <> {bins - 1}
              then d + 1 else d end as bin
  from p1),
hc as (select bin, count(*) as cnt from p2 group by bin),
grid as (select unnest(range(0, {bins}))::int as bin from bd where cnt > 0)"""
    ) + f"""
select grid.bin,
       grid.bin::double * ((hi - lo) / {bins}.0::double) + lo as bin_lo,
       case when grid.bin + 1 >= {bins} then hi else (grid.bin + 1)::double * ((hi - lo) / {bins}.0::double) + lo end as bin_hi,
       coalesce(hc.cnt, 0)::bigint as count
from grid cross join bd left join hc on hc.bin = grid.bin"""


def _sweep() -> str:
    values = ", ".join(f"({s}::double, {c}::double)" for s, c in SWEEP_SETTINGS)
    return _with(
        BASKETS,
        SUBSETS,
        f"""
allsets as (select items, count(*) as freq from sub group by items),
cand as (select items as u, freq as fu, unnest(items) as cons from allsets where len(items) > 1),
rr as (
  select c.fu, c.fu / fa.freq::double as conf
  from (select list_filter(u, lambda z: z <> cons) as a, fu from cand) c
  join allsets fa on fa.items = c.a),
st(min_support, min_confidence) as (values {values})""",
        recursive=True,
    ) + """
select st.min_support, st.min_confidence,
       (select count(*) from allsets where freq >= ceil(st.min_support * n.n))::bigint as n_itemsets,
       (select count(*) from rr where fu >= ceil(st.min_support * n.n) and conf >= st.min_confidence)::bigint as n_rules
from st cross join n"""


def _needle_match(side: str, needle: str) -> str:
    return f"len(list_filter({side}, lambda z: contains(z, '{needle}'))) > 0"


CLEAN_BASKETS = _with(BASKETS) + """
select b as basket_id, count(*)::bigint as basket_size, array_to_string(list_sort(list(i)), ', ') as items
from x group by b"""


def ORACLES() -> dict[str, str]:
    needle = SEARCH_NEEDLE.lower()
    rules_select = "select antecedent, consequent, support, confidence, lift from "
    return {
        "fold_wide_baskets": """
select l_orderkey as basket_id, count(*)::bigint as n_items,
       string_agg(p_brand, ', ' order by l_linenumber, p_brand) as items
from lineitem join part on l_partkey = p_partkey
group by l_orderkey""",
        "fold_wide_chunks": f"""
with r as (
  select l_suppkey, l_partkey, l_orderkey, l_linenumber,
         row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey::varchar) - 1 as place
  from lineitem)
select l_suppkey as basket_id, place // {CHUNK_WIDTH} as chunk, count(*)::bigint as n_items,
       string_agg(l_partkey::varchar, ', ' order by place) as items
from r group by l_suppkey, place // {CHUNK_WIDTH}""",
        "wide_cells_with_gaps": """
with c as (
  select (l_orderkey * 10 + l_linenumber)::bigint as basket_id, l_linenumber % 5 as n,
         ['  ' || l_returnflag || ' ',
          case when l_linenumber % 3 = 0 then null else 'Line ' || l_linenumber end,
          case when l_linestatus = 'F' then chr(9) || l_linestatus end,
          case when l_returnflag <> 'N' then l_returnflag end] as cells
  from lineitem),
f as (
  select basket_id, list_sort(list_distinct(list_transform(
    list_filter(cells[1:n], lambda x: x is not null), lambda x: lower(trim(x, ' '))))) as items
  from c where n > 0)
select basket_id, len(items)::bigint as n_items, array_to_string(items, ', ') as items
from f where len(items) > 0""",
        "clean_baskets": CLEAN_BASKETS,
        "wide_csv_baskets": CLEAN_BASKETS,
        "overview": _mined(ITEMS)
        + """
select (select count(*) from ok)::bigint as transactions,
       (select count(*) from ic)::bigint as unique_items,
       (select avg(cnt) from (select count(*) as cnt from x group by b)) as avg_basket_size,
       (select count(*) from rl)::bigint as total_rules,
       (select count(*) from fi)::bigint as total_itemsets""",
        "item_counts": _with(BASKETS, ITEMS) + "select item, cnt::bigint as count from ic",
        "top_items": _with(BASKETS, ITEMS)
        + """
select row_number() over (order by cnt desc, item)::bigint as rank, item, cnt::bigint as count
from ic order by cnt desc, item limit 20""",
        "item_statistics": _with(
            BASKETS,
            ITEMS,
            """
t20 as (select item, cnt, row_number() over (order by cnt desc, item) as rk from ic order by cnt desc, item limit 20)""",
        )
        + """
select (select sum(cnt) from ic)::bigint as total_occurrences,
       (select count(*) from ic)::bigint as unique_items,
       (select sum(cnt) from ic)::double / nullif((select count(*) from ic), 0) as avg_occurrence,
       (select item from t20 where rk = 1) as most_frequent_item,
       (select cnt from t20 where rk = 1)::bigint as most_frequent_count,
       (select item from t20 order by rk desc limit 1) as least_frequent_top_item,
       (select cnt from t20 order by rk desc limit 1)::bigint as least_frequent_top_count""",
        "top10_item_share": _with(
            BASKETS,
            ITEMS,
            """
t20 as (select item, cnt, row_number() over (order by cnt desc, item) as rk from ic order by cnt desc, item limit 20),
f as (
  select least(rk, 11) as rank, case when rk <= 10 then item else 'Others' end as item, sum(cnt) as count
  from t20 group by 1, 2 having sum(cnt) > 0)""",
        )
        + """
select rank::bigint as rank, item, count::bigint as count,
       count::double * 100.0::double / (select sum(cnt) from t20)::double as percent_of_top
from f""",
        "basket_size_distribution": _with(BASKETS)
        + """
select basket_size, count(*)::bigint as count
from (select b, count(*)::bigint as basket_size from x group by b) group by basket_size""",
        "frequent_itemsets": _mined()
        + "select array_to_string(items, ', ') as items, len(items)::bigint as size, freq::bigint as freq from fi",
        "association_rules": _mined() + "select antecedent, consequent, confidence, lift, support from rl",
        "frequent_itemsets_loosened": _mined()
        + "select array_to_string(items, ', ') as items, len(items)::bigint as size, freq::bigint as freq from fi",
        "association_rules_loosened": _mined() + "select antecedent, consequent, confidence, lift, support from rl",
        "mine_sweep": _sweep(),
        "top_itemsets": _mined()
        + """
select array_to_string(items, ', ') as items, freq::bigint as freq
from fi order by freq desc, array_to_string(items, ', ') limit 20""",
        "top_rules_by_lift": _mined(_ordered_rules(20)) + rules_select + "tr",
        "top_rules_by_lift_labelled": _mined(_ordered_rules(10))
        + "select antecedent || ' → ' || consequent as rule, lift from tr",
        "explore_rules": _mined()
        + rules_select
        + "rl where lift >= 1.0::double and support >= (select min(support) from rl)",
        "explore_rules_count": _mined()
        + """
select count(*) filter (where lift >= 1.0::double and support >= (select min(support) from rl))::bigint as shown,
       count(*)::bigint as total
from rl""",
        "explore_rules_searched": _mined()
        + f"""
select array_to_string(a, ', ') as antecedent, array_to_string(k, ', ') as consequent, support, confidence, lift
from rules
where lift >= {EXPLORE_MIN_LIFT}::double and support >= {EXPLORE_MIN_SUPPORT}::double
  and ({_needle_match('a', EXPLORE_NEEDLE.lower())} or {_needle_match('k', EXPLORE_NEEDLE.lower())})""",
        "search_rules": _mined()
        + f"""
select array_to_string(a, ', ') as antecedent, array_to_string(k, ', ') as consequent, support, confidence, lift
from rules
where {_needle_match('a', needle)} or {_needle_match('k', needle)}""",
        "rule_insight": _mined(
            """
pick as (
  select * from rl
  where lift >= 1.0::double and support >= (select min(support) from rl)
  order by lift desc nulls last, antecedent, consequent limit 1)"""
        )
        + """
select antecedent || ' → ' || consequent as rule, antecedent, consequent, support, confidence, lift,
       case when lift > 1 then printf('Customers who buy **%s** are **%sx** more likely to also buy **%s** compared to random chance.',
                                      antecedent, printf('%.1f', lift), consequent)
            when lift = 1 then printf('Items **%s** and **%s** are independent of each other.', antecedent, consequent)
            else printf('Customers who buy **%s** are less likely to buy **%s**.', antecedent, consequent) end as insight,
       printf('Confidence means: %s of customers who bought %s also bought %s',
              printf('%.1f', confidence * 100.0::double) || '%', antecedent, consequent) as confidence_text
from pick""",
        "support_confidence_points": _mined()
        + "select antecedent, consequent, support, confidence, lift, lift * 50.0::double as bubble_size from rl",
        "rule_statistics": _mined()
        + """
select round(avg(lift), 6) as lift_mean, round(median(lift), 6) as lift_median,
       min(lift) as lift_min, max(lift) as lift_max,
       round(avg(confidence), 6) as confidence_mean, min(confidence) as confidence_min, max(confidence) as confidence_max,
       round(avg(support), 6) as support_mean, min(support) as support_min, max(support) as support_max
from rl""",
        "lift_histogram": _histogram("lift"),
        "confidence_histogram": _histogram("confidence"),
        "support_histogram": _histogram("support"),
        "cooccurrence_matrix": _cooccurrence(10),
        "cooccurrence_matrix_top20": _cooccurrence(20),
        "top_item_pairs": _with(BASKETS, ITEMS, TOP10)
        + """
select t1.item as item_1, t2.item as item_2, t1.item || ' & ' || t2.item as pair, pc.n::bigint as frequency
from top t1 join top t2 on t1.pos < t2.pos join pc on pc.i1 = t1.item and pc.i2 = t2.item
order by pc.n desc, t1.pos, t2.pos limit 10""",
        "rule_graph_nodes": _mined(
            """
tr as (select * from rules order by lift desc nulls last, array_to_string(a, ', '), array_to_string(k, ', ') limit 20),
sides as (select a as side from tr union all select k from tr),
nd as (
  select unnest(side) as node, 'item' as type from sides
  union all
  select array_to_string(side, ', ') as node, 'itemset' as type from sides where len(side) > 1)"""
        )
        + """
select node, min(type) as type, case when min(type) = 'item' then 25 else 35 end as size
from nd group by node""",
        "rule_graph_edges": _graph_edges(20),
        "rule_graph_edges_top50": _graph_edges(50),
        "export_rules": _mined() + "select antecedent, consequent, confidence, lift, support from rl",
        "export_itemsets": _mined() + "select array_to_string(items, ', ') as items, freq::bigint as freq from fi",
        "frequent_itemsets_defaults": _other(ORDER_BRANDS, DEFAULTS_SPEC.min_support, DEFAULTS_SPEC.min_confidence)
        + ITEMSETS_SELECT,
        "association_rules_defaults": _other(ORDER_BRANDS, DEFAULTS_SPEC.min_support, DEFAULTS_SPEC.min_confidence)
        + RULES_SELECT,
        "frequent_itemsets_part_types": _other(ORDER_TYPES, TYPE_SPEC.min_support, TYPE_SPEC.min_confidence) + ITEMSETS_SELECT,
        "association_rules_part_types": _other(ORDER_TYPES, TYPE_SPEC.min_support, TYPE_SPEC.min_confidence) + RULES_SELECT,
        "frequent_itemsets_part_names": _other(ORDER_NAMES, NAME_SPEC.min_support, NAME_SPEC.min_confidence) + ITEMSETS_SELECT,
        "association_rules_part_names": _other(ORDER_NAMES, NAME_SPEC.min_support, NAME_SPEC.min_confidence) + RULES_SELECT,
        "frequent_itemsets_events": _other(USER_EVENTS, EVENT_SPEC.min_support, EVENT_SPEC.min_confidence) + ITEMSETS_SELECT,
        "association_rules_events": _other(USER_EVENTS, EVENT_SPEC.min_support, EVENT_SPEC.min_confidence) + RULES_SELECT,
    }
