"""Pages that differ only in numbers, and what parsing holds."""

import gc
import random

from pagelake.operators import forms
from pagelake.operators.alike import Alike
from pagelake.operators.dom import Document, Node
from pagelake.plans import queries_render
from pagelake.plans.parse import PAGE_ROWS, extract
from pagelake.plans.registry import RENDERED, spread

PARTS = (
    "<form id=f{} action='/a{}?q={}'>", "<input id={} name=n{} minlength={} MaxLength='{}'>", "<label for={}>no {} 50% {}</label>", "<h{}>x<h{}>y</h{}>",
    "<input name='csrf{}' type=hidden value=\"{}-{}\">", "<select id=n{}><option value={}>{}<option>{}</select>", "<textarea id={}>\n{} &amp; {}</textarea>",
    "a&sup{};b", "&#5{};", "<input id='&#5{};'>", "<input id=a&amp{}>", "<button type=submit value={}>", "</form>", "<label>{}<input id={}></label>", "<!-- {} -->", "<b {}={}>", "<a{}>", "<5{}>", "{}",
)


def read(text):
    return forms.forms(Document(text))


def test_templates_equal_reading_each_page():
    rng = random.Random(5)
    alike, pages, calls = Alike(lambda t: calls.append(t) or read(t)), [], []
    for _ in range(300):
        form = PARTS[0] + "".join(rng.choices(PARTS, k=rng.randint(1, 7)))
        for _ in range(8):
            pages.append(form.format(*(rng.choice(("0", "1", "2", "12", "21", "007", "123456")) for _ in range(form.count("{}")))))
    rng.shuffle(pages)
    assert [alike(p) for p in pages] == [read(p) for p in pages]
    assert len(calls) < len(pages)


def test_pages_that_differ_in_numbers_are_read_once():
    calls = []
    alike = Alike(lambda t: calls.append(t) or read(t))
    pages = [f"<form><input id=a{k} name=m{k} minlength=3><label for=a{k}>no {k + 1}</label></form>" for k in range(1_000)]
    found = [alike(p)[0]["fields"][0] for p in pages]
    assert len(calls) < 10
    assert [(f["name"], f["label"], f["min_length"]) for f in found] == [(f"m{k}", f"no {k + 1}", 3) for k in range(1_000)]


def test_templates_are_bounded(monkeypatch):
    monkeypatch.setattr("pagelake.operators.alike.KNOWN", 2_000)
    alike = Alike(read)
    for k in range(200):
        for n in range(3):
            assert alike(f"<form><input name={'x' * (k + 1)}{n}></form>")[0]["fields"][0]["name"] == "x" * (k + 1) + str(n)
    assert sum(map(len, alike.kinds)) <= 2_000


def test_freed_trees_need_no_collector():
    gc.collect()
    gc.disable()
    try:
        held = sum(isinstance(o, Node) for o in gc.get_objects())
        for _ in range(20):
            doc = Document("<title>t</title><p>a<b>b<i>c</b>d<ul><li>x<li>y</ul><table><tr><td>z</table><!-- c -->")
            doc.free()
            del doc
        assert sum(isinstance(o, Node) for o in gc.get_objects()) == held
    finally:
        gc.enable()


def test_batches_and_tasks_are_bounded(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        pages = spark.range(3).selectExpr("'<form>' AS html", "'http://h/' AS url")
        extract(pages, "forms")
        assert int(spark.conf.get(key)) == PAGE_ROWS
        spark.conf.set(key, "7")
        extract(pages, "forms")
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert spread(orders, 1 << 10).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert spread(orders, RENDERED).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert queries_render._forms_of(spark, sf_dir).count() == orders.count()
