"""Command line: ``python -m certloom.cli watch | kpis | feed-kpis | tail | build-watchlist``.

For ``watch``, flags win over the configuration file, which wins over defaults.
"""

import argparse
import hashlib
import logging
import sys
import time
import uuid
from dataclasses import dataclass, fields
from pathlib import Path

import yaml

log = logging.getLogger("certloom")

CONFIG = "data/config.yml"
#: Files that analysts edit; their paths are not settings.
TERMS_FILE = "data/detection_terms.yml"
SHARED_HOSTING_FILE = "data/shared_hosting_suffixes.yml"


@dataclass
class RunConfig:
    source: str = "certstream"
    certstream_url: str = "ws://127.0.0.1:8080/"
    fixtures_path: str = "tests/fixtures/certs.jsonl"
    watchlist: str = "data/watchlist.yml"
    rules_config: str = "data/rules.yml"
    output: str | None = None
    skip_wildcards: bool = True
    detection: bool = False
    metrics: bool = False
    metrics_interval: float = 10.0
    seconds: float | None = None


def load_config(path: str | Path = CONFIG) -> RunConfig:
    """Settings of a file; a missing file or key means the default, an empty file is an error."""
    if not Path(path).exists():
        return RunConfig()
    said = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(said, dict):
        raise ValueError(f"{path} holds no settings")
    known = {f.name for f in fields(RunConfig)}
    return RunConfig(**{k: v for k, v in said.items() if k in known})


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="certloom")
    commands = p.add_subparsers(dest="command", required=True)
    kpi = commands.add_parser("kpis", help="figures of a replay: totals, different hosts, top sources, detections")
    kpi.add_argument("path")
    kpi.add_argument("--top", type=int, default=15)
    tail = commands.add_parser("tail", help="show the records of a growing output folder")
    tail.add_argument("folder")
    tail.add_argument("--from-start", action="store_true")
    build = commands.add_parser("build-watchlist", help="write a watchlist from a seed and a ranking")
    for name in ("seed", "ranking", "output"):
        build.add_argument(name)
    watch = commands.add_parser("watch", help="read certificates and write detections")
    watch.add_argument("--config", default=CONFIG)
    watch.add_argument("--source", help="certstream or fixtures")
    for name in ("certstream-url", "watchlist", "rules-config", "output", "fixtures-path"):
        watch.add_argument(f"--{name}")
    for name in ("skip-wildcards", "detection", "metrics"):
        watch.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    watch.add_argument("--metrics-interval", type=float)
    watch.add_argument("--seconds", type=float, help="end a live run after this time; a run without end if not given")
    feed = commands.add_parser("feed-kpis", help="figures of a live feed at fixed times, then stop")
    feed.add_argument("--certstream-url", default=RunConfig.certstream_url)
    feed.add_argument("--at", type=lambda s: tuple(map(float, s.split(","))), default=(60.0, 300.0, 600.0), help="seconds, with commas between")
    feed.add_argument("--top", type=int, default=15)
    return p


def settings(argv: list[str]) -> RunConfig:
    args = _parser().parse_args(argv)
    run = load_config(args.config)
    for f in fields(RunConfig):
        if (said := getattr(args, f.name, None)) is not None:
            setattr(run, f.name, said)
    if run.source not in ("certstream", "fixtures"):
        raise SystemExit(f"unknown source: {run.source!r} (certstream or fixtures)")
    return run


def detect_context(run: RunConfig):
    from certloom.operators import context

    if not run.detection:
        return None
    return context.make_context(
        context.read_watchlist(run.watchlist), terms=context.read_terms(TERMS_FILE), rules=context.read_rules(run.rules_config),
        shared=context.read_shared_hosting(SHARED_HOSTING_FILE),
    )


def checkpoint_of(spark, run: RunConfig) -> str:
    """Where a live run goes on: one place for each feed and output, so that a restart neither loses nor repeats a batch."""
    from certloom.session import shared_dir

    told = "\n".join(map(str, (run.certstream_url, run.output, run.detection, run.metrics)))
    return f"{shared_dir(spark)}/watch-{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def watch(run: RunConfig, spark=None) -> int:
    """Runs to the end of a replay, or until interrupted; returns how many records came out."""
    from certloom.session import build_session
    from certloom.sources import live, messages
    from certloom.streaming import detection

    if not Path(run.watchlist).exists():
        log.warning("no watchlist at %s; going on without it", run.watchlist)
    if run.metrics and not run.detection:
        log.warning("metrics need detection; they are left out")
    spark = spark or build_session("watch")
    ctx = detect_context(run)
    figures = detection.RunningFigures() if run.metrics and run.detection else None
    counted: list[int] = []
    aside: dict[int, int] = {}
    began = time.monotonic()
    checkpoint = None if run.source == "fixtures" else checkpoint_of(spark, run)
    name = detection.run_name(checkpoint) if checkpoint else uuid.uuid4().hex[:16]  # each replay adds to the output
    write = detection.batch_writer(run.output, name, ctx, run.skip_wildcards, figures, counted)
    if run.source == "fixtures":
        write(messages.to_events(messages.read_messages(spark, run.fixtures_path), strict=True), 0)
    else:
        spark.dataSource.register(live.CertFeed)
        frames = spark.readStream.format("certfeed").option("url", run.certstream_url).load()
        query = messages.parse_frames(frames).writeStream.foreachBatch(detection.message_writer(write, aside)).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
        try:
            last = time.monotonic()
            while not query.awaitTermination(max(0.01, run.metrics_interval if figures is not None else 1.0)):
                now = time.monotonic()
                if run.seconds is not None and now - began >= run.seconds:
                    query.stop()
                    break
                if figures is not None:
                    print(figures.snapshot(now - began, now - last), _incomplete(aside), sep="\n", file=sys.stderr)
                    last = now
        except KeyboardInterrupt:
            query.stop()
    if figures is not None:
        span = time.monotonic() - began
        print(figures.snapshot(span, span), file=sys.stderr)
        n = figures.totals["n_found"]
    else:
        n = sum(counted)
    if run.source != "fixtures":  # a replay stops at the first one
        print(_incomplete(aside), file=sys.stderr)
    print(f"done: {n} {'detection(s)' if run.detection else 'certificate(s) processed'}", file=sys.stderr)
    return n


def _incomplete(aside: dict[int, int]) -> str:
    return f"incomplete certificate messages put aside: {sum(aside.values())}"


def kpis(spark, path: str, top: int) -> str:
    """Figures of a replay as text; detection runs without brands and terms, wildcards stripped."""
    from certloom.operators import kpis as figures
    from certloom.operators.context import DetectContext
    from certloom.operators.detect import detect, strip_wildcards
    from certloom.sources import messages

    read = messages.read_messages(spark, path)
    events = messages.to_events(read)
    fed, unique = figures.feed_totals(events).first(), figures.distinct_hosts(events).first()
    lines = [f"certs:   {fed.n_certs}", f"domains: {fed.n_domains} total, {unique.n_unique} unique", _incomplete({0: messages.invalid_messages(read).count()}), f"by source (top {top}):"]
    lines += [f"  {r.source or '?':<45} {r.n_certs:>8} {r.percent:5.1f} %" for r in figures.top_sources(events, top).collect()]
    plain = strip_wildcards(events)
    found = figures.detection_totals(plain, detect(plain, DetectContext(), skip_wildcards=False)).first()
    lines.append(f"detections without lists: {found.n_reasons} ({found.percent_of_domains:.2f} % of domains)")
    return "\n".join(lines)


def build_watchlist(spark, seed: str, ranking: str, output: str) -> dict[str, int]:
    """Writes the watchlist file; returns the number of brands by sector. A ranking may be a zip archive."""
    from certloom.operators import watchlist
    from certloom.session import materialise

    ranked = watchlist.read_ranking_archive(spark, ranking) if ranking.endswith(".zip") else watchlist.read_ranking(spark, ranking)
    entries = materialise(watchlist.build(spark, yaml.safe_load(Path(seed).read_text(encoding="utf-8")) or {}, ranked), "watchlist")
    watchlist.write_yaml(entries, output)
    counts = {r.sector: r.n for r in watchlist.sector_counts(entries).collect()}
    return {s: counts.get(s, 0) for s in watchlist.SECTORS}


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    argv = sys.argv[1:] if argv is None else argv
    args = _parser().parse_args(argv)
    if args.command == "watch":
        watch(settings(argv))
        return
    from certloom.session import build_session
    from certloom.streaming import tail

    spark = build_session(args.command)
    if args.command == "feed-kpis":
        from certloom.sources import live, messages
        from certloom.streaming import feed_figures

        spark.dataSource.register(live.CertFeed)
        frames = spark.readStream.format("certfeed").option("url", args.certstream_url).load()
        feed_figures.at_landmarks(messages.to_events(messages.parse_frames(frames)), args.at, args.top)
    elif args.command == "kpis":
        print(kpis(spark, args.path, args.top))
    elif args.command == "tail":
        tail.follow(spark, args.folder, from_start=args.from_start).awaitTermination()
    else:
        for sector, n in build_watchlist(spark, args.seed, args.ranking, args.output).items():
            print(f"{sector:12} {n}")


if __name__ == "__main__":
    main()
