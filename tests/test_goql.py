import pytest
from pyspark.sql import functions as F

from terrane.plans import goql

# (tags, query, expected)
CASES = [
    ({"highway": "no"}, "[highway]", False), ({"highway": "no"}, "[!highway]", True), ({"highway": "no"}, "[highway=no]", True), ({"highway": "no"}, '[highway="*"]', True),
    ({"highway": "no"}, "[highway][highway=no]", True), ({"highway": "no"}, "[highway][highway!=x]", False),
    ({}, "[highway!=x]", True), ({}, '[highway!~"x"]', True), ({}, '[highway!="*"]', True), ({}, "[maxspeed<50]", False), ({}, "[maxspeed!=50]", True),
    ({"maxspeed": "50 mph"}, "[maxspeed<=50]", True), ({"maxspeed": "50 mph"}, "[maxspeed=50]", True), ({"maxspeed": "50 mph"}, '[maxspeed="50"]', False), ({"maxspeed": "50 mph"}, '[maxspeed="*mph"]', True),
    ({"maxspeed": "none"}, "[maxspeed>0]", False), ({"maxspeed": "none"}, "[maxspeed<0]", False), ({"maxspeed": "none"}, "[maxspeed!=0]", True),
    ({"maxspeed": "83.13"}, "[maxspeed=15,30,83.13]", True), ({"maxspeed": "83.13"}, '[maxspeed="83*"]', True),
    ({"name": "ab"}, '[name~"a|ab"]', False), ({"name": "ab"}, '[name~"ab|a"]', True), ({"name": "ab"}, '[name~"b"]', False),
    ({"name": "100%_x"}, '[name="100%*"]', True), ({"name": "100%_x"}, '[name="*_y"]', False), ({"k": "v"}, "[!k][k!=z]", False),
    ({"highway": "primary"}, "w[highway>32]", False), ({"highway": "primary"}, "w[highway!=32]", True), ({"highway": "primary"}, "[highway!=32][highway!=5]", True),
    ({"a:b": "x"}, '["a:b"=x]', True), ({"a:b": "x"}, "[a:b=x]", True), ({"n": "it's"}, "[n='it\\'s']", True), ({"n": "a*b"}, '[n="a*b"]', True),
    ({"n": "-5.5"}, "[n=-5.5]", True), ({"n": "--2"}, "[n!=2]", True), ({"n": ".5"}, "[n<1]", True), ({"n": "1e5"}, "[n=1]", True), ({"n": "+5"}, "[n>0]", False),
    ({"h": "motorway"}, 'w[h=motorway,"x"], w[h=primary]', True), ({"h": "primary"}, "n[h=x], w[h=primary]", True),
]
ERRORS = ["[!k][k]", "[!k][k=v]", "[k][!k]", "[k>1,2]", '[k>"a"]', "[!]", "x[k]", "nn", "[k", "[k~44]", "[k=]", "w[k]]", ""]


def test_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, tags map<string,string>").withColumn("category", F.lit("w"))
    for i, (_, query, _) in enumerate(CASES):
        rows = rows.withColumn(f"q{i}", goql.compile_query(goql.parse(query), lambda k: F.try_element_at("tags", F.lit(k)), F.col("category")))
    for r in rows.collect():
        assert r[f"q{r['i']}"] is CASES[r["i"]][2], CASES[r["i"]]
        assert all(r[f"q{k}"] is not None for k in range(len(CASES)))


@pytest.mark.parametrize("query", ERRORS)
def test_errors(query):
    with pytest.raises(goql.QueryError):
        goql.parse(query)


def test_error_place():
    with pytest.raises(goql.QueryError) as e:
        goql.parse("w[k>\n'a']")
    assert (e.value.line, e.value.column) == (2, 1)


def test_types_and_parity():
    assert goql.types_of(goql.parse("na[x]")) == {"n", "a"} and goql.types_of(goql.parse("*")) == goql.ALL
    with pytest.raises(goql.QueryError):
        goql.parse("n[a], w[b]", True)
