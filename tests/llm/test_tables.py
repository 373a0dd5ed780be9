import re

from memlake.llm import tables
from memlake.llm.tables import saved


def test_written_tables_leave_no_garbage_in_the_driver(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    assert saved(spark.range(3), "three").count() == 3
    assert collections() > before


def test_free_native_memory_goes_back_to_the_system(spark):
    def resident():
        pid = spark._jvm.java.lang.ProcessHandle.current().pid()
        return int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{pid}/status").read())[1])

    for n in range(20):
        spark.range(100 * n).selectExpr(f"id % {n + 3} AS k{n}").groupBy(f"k{n}").count().collect()
    spark._jvm.System.gc()
    before = resident()
    if tables.tidied(spark):
        assert resident() < before
