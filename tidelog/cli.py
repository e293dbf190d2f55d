"""python -m tidelog.cli PATH put KEY VALUE | get KEY | delete KEY | scan [BEGIN [END]] | bench [N]"""

from __future__ import annotations

import random
import sys
import time

from pyspark.sql import SparkSession

from .sources.batch import WriteBatch
from .sources.store import KVStore


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    path, command, *rest = args
    with KVStore.open(spark, path) as store:
        if command == "put":
            store.put(rest[0], rest[1])
        elif command == "delete":
            store.delete(rest[0])
        elif command == "get":
            value = store.get(rest[0])
            if value is None:
                return 1
            print(value)
        elif command == "scan":
            for r in store.scan(*rest[:2]).toLocalIterator():
                print(f"{r.key}\t{r.value}")
        elif command == "bench":
            n = int(rest[0]) if rest else 10_000
            draw, batch = random.Random(0xDEADBEEF), WriteBatch()
            for _ in range(n):
                i = draw.randrange(n)
                batch.put(f"key{i:012d}", f"value-{i:012d}-payload")
            t = time.time()
            store.write(batch)
            wrote, t = time.time() - t, time.time()
            asked = [f"key{draw.randrange(n):012d}" for _ in range(n)]
            found = store.multi_get(asked)
            print(f"{n} random puts in {wrote:.2f} s, {sum(k in found for k in asked)} of {n} random gets found in {time.time() - t:.2f} s")
        else:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
