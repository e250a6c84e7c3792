"""Per-stage times from a Spark event log (no UI needed).

Usage: python scripts/stage_times.py <event log file or folder> [--top N]
Prints the slowest stages (duration, tasks, shuffle read/write, spill, the
job description bench.py sets per query) and the total stage time per query.
Reads plain and zstd-compressed logs, and Spark's rolling log folders.
"""

from __future__ import annotations

import argparse
import io
import json
import os
from collections import defaultdict


def _files(path: str):
    if not os.path.isdir(path):
        yield path
        return
    for root, _dirs, names in os.walk(path):
        for n in sorted(names):
            # single-file logs are named after the app; rolling ones hold events_* parts
            if n.startswith(("events_", "local-", "app-", "application_")) and not n.endswith(".crc"):
                yield os.path.join(root, n)


def _lines(f: str):
    if f.endswith(".zstd"):
        import zstandard
        with open(f, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(f, encoding="utf-8") as fh:
            yield from fh


def stages(path: str):
    desc = {}
    for f in _files(path):
        for line in _lines(f):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                d = " ".join(((ev.get("Properties") or {}).get("spark.job.description") or "").split())[:60]
                for s in ev.get("Stage IDs", []):
                    desc[s] = d
                continue
            if kind != "SparkListenerStageCompleted":
                continue
            info = ev["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
            dur = (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0)
            yield {
                "stage": info["Stage ID"], "name": info["Stage Name"][:50], "ms": dur,
                "query": desc.get(info["Stage ID"], ""),
                "tasks": info["Number of Tasks"],
                "shuffle_read": int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0),
                "shuffle_write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                "spill": int(acc.get("internal.metrics.diskBytesSpilled", 0) or 0),
                "input": int(acc.get("internal.metrics.input.bytesRead", 0) or 0),
            }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("path")
    ap.add_argument("--top", type=int, default=20)
    args = ap.parse_args()
    all_rows = list(stages(args.path))
    rows = sorted(all_rows, key=lambda r: -r["ms"])[: args.top]
    print(f"{'stage':>6} {'ms':>8} {'tasks':>6} {'input':>10} {'shuf_r':>10} {'shuf_w':>10} {'spill':>8}"
          "  query / name")
    for r in rows:
        print(f"{r['stage']:>6} {r['ms']:>8} {r['tasks']:>6} {r['input']:>10} {r['shuffle_read']:>10} "
              f"{r['shuffle_write']:>10} {r['spill']:>8}  {r['query']} / {r['name']}")
    per_query = defaultdict(int)
    for r in all_rows:
        per_query[r["query"]] += r["ms"]
    print("\nstage ms per query (all runs):")
    for q, ms in sorted(per_query.items(), key=lambda kv: -kv[1]):
        print(f"{ms:>10}  {q}")


if __name__ == "__main__":
    main()
