"""Java sources: nested and overloaded declarations, braces in literals, receivers by their types."""

import pytest

from seamline.operators import java

ORDER = '''package shop.order;

import java.util.*;
import shop.base.Money;
import shop.util.*;

/** class Hidden { void no() { } } */
@Entity(name = "x{")
public class Order<T extends Comparable<T>> extends BaseOrder<T> implements Sellable {
    private static final String BRACES = "}}{" + '}' + "\\"{";
    private Money price = new Money(), tax;
    protected Map<String, List<Item>> items = new HashMap<>();
    int[] sizes = {1, 2};
    static { setUp(); }

    public Order(Money price) { this.price = price; check(price); }
    public void place(int n) { // }
        Item item = new Item();
        item.weigh().print();
        this.price.add(tax);
        for (Item i : find()) { i.weigh(); Util.log("place(" + i); }
        audit();
        super.place();
    }
    public void place(String s, final List<Money> all) throws Exception {
        place(1);
        var u = new Util();
        u.run(() -> { check(null); });
        unknown.call();
        shop.base.Money.zero();
        Runnable r = new Runnable() { public void run() { price.close(); } };
    }
    List<Item> find() { return null; }
    private void check(Money m) { if (m == null) { throw new IllegalStateException("{"); } }

    public static class Item {
        int w;
        Line line;
        Money weigh() { line.cut(); helper(); return null; }
        enum Unit { KG { int f() { return 1; } }, G; int f() { return 0; } }
    }
    interface Line { void cut(); default int two() { return 2; } }
    static void setUp() { }
    void helper() { Order.Item x = null; x.weigh(); }
}

class Second { Order<String> o; void go(Order.Item it) { o.place(1); it.weigh(); } }
'''
OTHERS = [
    ("BaseOrder.java", "package shop.order; public abstract class BaseOrder<T> extends Root { void place() { } void audit() { trace(); } }"),
    ("Root.java", "package shop.order; class Root { void trace() { } }"), ("Money.java", "package shop.base;\npublic class Money { public void add(Money m) { } public static Money zero() { return null; } }"),
    ("Util.java", "package shop.util; public class Util { static void log(String s) { } void run(Runnable r) { r.run(); } }"), ("bad.java", "class Open { void f() { g(); "), ("n.java", None),
]


@pytest.fixture(scope="module")
def declared(spark):
    return java.declarations(spark.createDataFrame([("Order.java", ORDER), *OTHERS], "path string, text string"))


def test_types_and_methods(declared):
    rows = declared.collect()
    types = {r["type"]: (r["form"], r["bases"], r["outer"]) for r in rows if r["kind"] == "type"}
    own = "shop.order.Order"
    assert types[own] == ("class", ["BaseOrder", "Sellable"], None) and types[f"{own}.Item"] == ("class", [], own) and types[f"{own}.Item.Unit"] == ("enum", [], f"{own}.Item") and types[f"{own}.Line"][0] == "interface"
    assert set(types) == {own, f"{own}.Item", f"{own}.Item.Unit", f"{own}.Line", "shop.order.Second", "shop.order.BaseOrder", "shop.order.Root", "shop.base.Money", "shop.util.Util", "Open"}
    of = lambda t: sorted(r["name"] for r in rows if r["kind"] == "method" and r["type"] == t)
    assert of(own) == ["Order", "check", "find", "helper", "place", "place", "setUp"] and of(f"{own}.Item") == ["weigh"] and of(f"{own}.Line") == ["cut", "two"] and of("shop.order.Second") == ["go"] and of("Open") == ["f"]
    place = [r for r in rows if r["type"] == own and r["name"] == "place"]
    lines = ORDER.split("\n")
    for r in place:
        assert lines[r["first"] - 1].strip().startswith("public void place") and lines[r["last"] - 1] == "    }" and r["text"].startswith("public void place") and r["text"].endswith("}")


def test_calls_by_receiver(declared):
    got = {(r["source"], r["target"]): r["n"] for r in java.call_graph(declared).collect()}
    o = "shop.order.Order"
    assert got == {
        (f"{o}.Order", f"{o}.check"): 1, (f"{o}.place", f"{o}.Item.weigh"): 2, (f"{o}.place", "shop.base.Money.add"): 1, (f"{o}.place", f"{o}.find"): 1, (f"{o}.place", "shop.util.Util.log"): 1,
        (f"{o}.place", "shop.order.BaseOrder.audit"): 1, (f"{o}.place", "shop.order.BaseOrder.place"): 1, (f"{o}.place", "shop.util.Util.run"): 1, (f"{o}.place", f"{o}.check"): 1, (f"{o}.place", "shop.base.Money.zero"): 1,
        (f"{o}.place", "shop.base.Money.close"): 1,  # nobody has it: it stays with the field's type
        (f"{o}.Item.weigh", f"{o}.Line.cut"): 1, (f"{o}.Item.weigh", f"{o}.helper"): 1, (f"{o}.helper", f"{o}.Item.weigh"): 1, ("shop.order.Second.go", f"{o}.place"): 1, ("shop.order.Second.go", f"{o}.Item.weigh"): 1,
        ("shop.order.BaseOrder.audit", "shop.order.Root.trace"): 1,
    }
