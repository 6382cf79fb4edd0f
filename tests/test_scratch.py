import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidemark.plans.scratch import cut, tables_read, tidy


def there(paths):
    return [os.path.exists(p) for p in paths]


def test_tidy_deletes_what_the_result_does_not_read(spark):
    made = []

    def build():
        a = cut(spark.range(10), "a")
        b = cut(a.where("id > 3"), "b")
        made.extend(x._tidemark_path for x in (a, b))
        return b.join(spark.range(5).withColumnRenamed("id", "n"), F.col("id") == F.col("n"))

    out, left = tidy(build)
    assert there(made) == [False, True] and left == made[1:] and out.count() == 1
    assert tables_read(out) == {made[1].rsplit("/", 1)[1]}
    # a result of a result keeps what it reads, too
    again, left = tidy(lambda: out.where("id = 4"))
    assert left == [] and again.count() == 1 and there(made) == [False, True]


def test_tidy_in_several_threads(spark):
    def run(n):
        first, _ = tidy(lambda: cut(cut(spark.range(n), "one").where("id >= 0"), "two"))
        return tidy(lambda: cut(first, "three").where("id >= 0"))[0]

    with ThreadPoolExecutor(3) as pool:
        outs = list(pool.map(run, [1, 2, 3, 4]))
    assert [o.count() for o in outs] == [1, 2, 3, 4]
