"""Columns that models read, through CTEs, subqueries and stars."""

import pytest

from faultline.operators import columns, lineage

UP = ("up", "select 1 as x", ["id", "amount", "paid_at", "kind"])
OTHER = ("other", "select 1", ["id", "label"])
OPEN = ("open_model", "select * from {{ source('raw', 'orders') }}", None)
PASS = ("passing", "with s as (select * from {{ ref('up') }}) select *, 1 as extra from s", None)
NARROW = ("narrow", "select id, amount from {{ ref('up') }}", None)

CASES = {
    "two CTEs": ("with a as (select * from {{ ref('up') }}), b as (select * from a) select b.id, gone from b", {"up.gone"}),
    "inner CTE names it": ("with a as (select gone as g from {{ ref('up') }}), b as (select g from a) select g from b", {"up.gone"}),
    "unqualified": ("select id, gone from {{ ref('up') }} where paid_at > '2020-01-01' and lost = 1", {"up.gone", "up.lost"}),
    "one of two holds": ("select u.id, label, amount from {{ ref('up') }} u join {{ ref('other') }} o on u.id = o.id", set()),
    "none of two holds": ("select gone from {{ ref('up') }} u join {{ ref('other') }} o using (id)", set()),
    "qualified of two": ("select o.amount, u.label from {{ ref('up') }} u, {{ ref('other') }} as o", {"other.amount", "up.label"}),
    "unknown table": ("select gone from {{ ref('up') }} u join raw.orders r on r.id = u.id", set()),
    "open model": ("select gone, m.lost from {{ ref('open_model') }} m", set()),
    "passed on by a model": ("select p.extra, p.amount, p.gone from {{ ref('passing') }} p", {"up.gone"}),
    "a model without stars": ("select n.kind from {{ ref('narrow') }} n", set()),
    "alias further up": ("select amount * 2 as twice, twice + 1 as more from {{ ref('up') }} order by more, twice", set()),
    "alias of its own column": ("select coalesce(gone, 0) as gone from {{ ref('up') }} group by gone", {"up.gone"}),
    "casts and parts": (
        "select amount::numeric(10, 2), cast(paid_at as date) d, extract(year from paid_at), date '2020-01-01', "
        "interval '1 day', count(*) n, case when kind = 'x' then 1 end as c from {{ ref('up') }}",
        set(),
    ),
    "windows": (
        "select row_number() over (partition by kind, gone order by paid_at desc nulls last) as rn from {{ ref('up') }} qualify rn = 1",
        {"up.gone"},
    ),
    "correlated": (
        "select id from {{ ref('up') }} u where exists (select 1 from {{ ref('other') }} o where o.id = u.gone and label = kind)",
        {"up.gone"},
    ),
    "subquery in from": ("select s.id, s.gone from (select * from {{ ref('up') }} where lost > 0) s", {"up.gone", "up.lost"}),
    "union": ("select id from {{ ref('up') }} union all select gone from {{ ref('other') }}", {"other.gone"}),
    "quoted and upper": ('SELECT U."ID", u."Gone" FROM {{ ref("up") }} AS U', {"up.gone"}),
    "comments and strings": ("select id -- u.gone\n, 'u.lost' /* u.x */ from {{ ref('up') }} u {# u.y #}", set()),
    "two arguments": ("select u.gone from {{ ref('package', 'up') }} u", {"up.gone"}),
    "config first": ("{{ config(materialized='table') }}\nselect gone from {{ ref('up') }}", {"up.gone"}),
    "star of one": (
        "with j as (select u.*, o.label from {{ ref('up') }} u join {{ ref('other') }} o on u.id = o.id) select j.label, j.amount, j.gone from j",
        {"up.gone"},
    ),
    "template in the list": ("with t as (select {{ dbt_utils.star(ref('up')) }} from {{ ref('up') }}) select t.gone from t", set()),
    "scalar subquery": ("select (select max(gone) from {{ ref('other') }} o2) as m, amount from {{ ref('up') }}", set()),
    "broken text": ("select id, (from where ))) select", set()),
    "no query": ("", set()),
}


@pytest.fixture(scope="module")
def breaks(spark):
    rows = [(name, code, None) for name, (code, _) in CASES.items()]
    nodes = spark.createDataFrame(
        [*rows, UP, OTHER, OPEN, PASS, NARROW, ("nothing", None, None)], "name string, raw_code string, columns array<string>"
    )
    found = {}
    for r in lineage.contract_breaks(nodes).collect():
        found.setdefault(r.node, set()).add(f"{r.upstream}.{r.column}")
    return found


@pytest.mark.parametrize("name", CASES)
def test_breaks(breaks, name):
    assert breaks.get(name.lower(), set()) == CASES[name][1]


def test_references(spark):
    nodes = spark.createDataFrame(
        [("m", "with a as (select * from {{ ref('up') }}) select a.id, gone from a", ["id"]), UP],
        "name string, raw_code string, columns array<string>",
    )
    got = {tuple(r) for r in columns.column_references(nodes).collect()}
    assert got == {("m", "up", "id", True), ("m", "up", "gone", False)}
