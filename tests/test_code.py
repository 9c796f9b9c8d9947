"""Program texts, class filters and diagnosis."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import words
from seamline.operators import code, diagnose, filters

JAVA = '''package com.shop.order;

import java.util.List;
import com.shop.base.Thing;
import static com.shop.base.Help.go;
import com.shop.star.*;

/* public void hidden() { } */
public class Order<T extends Thing> extends BaseOrder<T> implements Sellable, Other {
    private String url = "http://x/*not a comment*/";
    public Order() { }
    public static List<String> find(int a) { return null; }
    // public void gone() { }
    public void place (String s) throws Exception { }
    public void place(int n) { }
    public static void main(String[] args) { }
}
'''


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("Order.java", JAVA), ("BaseOrder.java", "package com.shop.order; abstract class BaseOrder<T> {}"), ("Sellable.java", "package com.shop.order; public interface Sellable {}"), ("e", ""), ("n", None)], "path string, text string")


def test_methods_types_imports(files):
    assert [r["name"] for r in code.public_methods(files).orderBy("path", "k").collect()] == ["find", "place"]
    got = {r["path"]: (r["fqcn"], r["kind"], r["bases"]) for r in code.types(files).collect()}
    assert got["Order.java"] == ("com.shop.order.Order", "class", ["BaseOrder", "Sellable", "Other"]) and got["Sellable.java"][1] == "interface" and len(got) == 3
    assert {r["target"] for r in code.imports(files).collect()} == {"java.util.List", "com.shop.base.Thing", "com.shop.base.Help.go"}
    assert {r["target"] for r in code.hierarchy(files).collect()} == {"com.shop.order.BaseOrder", "com.shop.order.Sellable"}


def test_calls(spark):
    calls = spark.createDataFrame([("a.A.m", "b.jpa.E.n"), ("b.jpa.E.n", "a.B.k"), ("a.A.m", "a.B.k"), ("a.B.k", "a.A.m"), ("b.jpa.E.n", "b.jpa.F.n"), ("a.A.m", "a.A.x")], "source string, target string")
    assert {tuple(r) for r in code.class_entities(calls).collect()} == {("a.A", "b.jpa.E"), ("a.B", "b.jpa.E")}
    assert ("a.A", "a.B") in {tuple(r) for r in code.class_calls(calls).collect()} and code.class_calls(calls).count() == 4


def test_predicates(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    n = F.lit
    assert row(filters.is_business(n("com.own.TestX"), ("com.own.",)), filters.is_business(n("org.apache.X")), filters.is_business(n("x.MockY")), filters.is_business(n("x.Y"))) == (True, False, False, True)
    assert row(filters.is_root_base(n("a.EntityBase")), filters.is_root_base(n("a.AbstractX")), filters.is_root_base(n("a.Order"))) == (True, True, False)
    assert row(filters.is_entity_like(n("a.Entities.X")), filters.is_noise_package(n("a.b.OrderDTO")), filters.is_noise_package(n("a.shop.Order"), ("shop",)), filters.is_noise_package(n("a.b.Order"))) == (True, True, True, False)
    assert row(filters.is_common_library(n("java.util.List")), filters.is_platform(n("java.util.X")), filters.is_stored_entity(n("a.war.OrderInfo"))) == (True, True, True)
    names = spark.createDataFrame([("x.util.A",), ("y.B",)], "n string")
    assert [r["n"] for r in filters.candidates(names, names, "x").orderBy("n").collect()] == ["x.util.A", "y.B"]  # none is left: the semantic ones
    assert [r["n"] for r in filters.candidates(names, names, "y").collect()] == ["y.B"]
    flags = spark.createDataFrame([("b", True, False, True), ("a", False, True, True), ("c", True, True, False)], "n string, has_callgraph boolean, has_dependency boolean, has_semantic boolean")
    assert [tuple(r) for r in filters.covered(flags).orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    rules = spark.createDataFrame([("a b",), ("c",), ("c",)], "key string")
    assert {tuple(r) for r in filters.unreachable_rules(rules, lambda c: F.replace(c, F.lit(" "), F.lit(""))).collect()} == {("a b", "not normal"), ("c", "duplicate")}


def test_stopwords():
    every = words.stopwords((" Foo ",))
    assert len(set(every)) == len(every) and {"foo", "dao", "void", "svc"} <= set(every) and "svc" not in words.stopwords(domain=False)


def test_spectral_splits_two_cliques(spark):
    rows = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5, 0.05)]
    got = {r["n"]: r["cluster"] for r in diagnose.spectral(spark.createDataFrame(rows, "i long, j long, v double"), 2).collect()}
    assert len({got[n] for n in range(5)}) == 1 and len({got[n] for n in range(5, 10)}) == 1 and got[0] != got[9]


def test_diagnosis_values(spark):
    sim = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.0)], "i string, j string, v double")
    assert tuple(diagnose.density(sim, 3).first()) == (2, 2 / 6, 2 / 9)
    assert {r["n"]: (r["weight"], r["deg"]) for r in diagnose.degrees(sim).collect()} == {"a": (0.5, 1), "b": (0.5, 1)}
    assert diagnose.adaptive_k(sim.where("v > 0")).first()["k"] == pytest.approx(np.log(2) / 0.5)
    assert diagnose.adaptive_k(sim.where("v = 0")).first()["k"] is None
    assert diagnose.merge_spec("1,3->1; 2->0") == {1: 1, 3: 1, 2: 0}
    with pytest.raises(ValueError):
        diagnose.merge_spec("1,2")
