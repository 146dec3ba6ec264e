"""Command line over a repository folder: python -m weftline.cli --repo PATH COMMAND."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from weftline import config
from weftline.operators import compare, stats, store
from weftline.operators.remotes import Remotes
from weftline.operators.repository import Repository, RepositoryError, clone
from weftline.sources import tensors


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline")
    out.add_argument("--repo", default=".", help="folder of the repository")
    sub = out.add_subparsers(dest="command", required=True)
    add = lambda name, *args, **flags: _arguments(sub.add_parser(name), args, flags)
    add("init")
    add("add", "path")
    add("commit", message=None, author="", tag=None)
    add("status")
    add("log", number=10, branch=None)
    add("checkout", "target")
    add("branch", "name?", delete=False)
    add("merge", "branch", strategy="ours", alpha=0.5)
    add("diff", "old", "new")
    add("compare", "old", "new")
    add("tag", "name", ref=None, description=None)
    add("show", "name", ref=None)
    add("gc", remove=False)
    add("remote", "action", "name?", "url?")
    add("push", "remote", force=False)
    add("pull", "remote", force=False)
    add("sync-status", "remote")
    add("clone", "url")
    add("stats")
    add("config", "key?", "value?")
    add("publish", "ref", "target", format="npz")
    return out


def _arguments(p: argparse.ArgumentParser, args, flags) -> None:
    for a in args:
        p.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
    for name, default in flags.items():
        if isinstance(default, bool):
            p.add_argument(f"--{name}", action="store_true")
        else:
            p.add_argument(f"--{name}", default=default, type=type(default) if isinstance(default, (int, float)) else str)


def run(spark, argv: list[str], out=print) -> int:
    """0 if the command worked, 1 with a line that says why it didn't."""
    args = parser().parse_args(argv)
    try:
        return _run(spark, args, out) or 0
    except (RepositoryError, ValueError, KeyError) as e:
        out(f"error: {e}")
        return 1


def _run(spark, args, out):
    if args.command == "init":
        Repository(spark, args.repo, init=True)
        return out(f"empty repository in {args.repo}")
    if args.command == "clone":
        clone(spark, args.url, args.repo)
        return out(f"cloned {args.url}")
    repo = Repository(spark, args.repo, init=False)
    repo.open_head()
    known = Remotes(spark, f"{args.repo}/remotes")
    command = args.command
    if command == "add":
        rows = tensors.read_safetensors(spark, args.path) if args.path.endswith(".safetensors") else tensors.read_numpy(spark, args.path)
        staged = repo.stage(rows.filter("error is null").select("name", "values"))
        for r in staged.orderBy("name").collect():
            out(f"{r['kind']:<10}{r['name']}" + (f" of {r['ref']}" if r["kind"] != "unique" else ""))
    elif command == "commit":
        out(repo.commit_staged(args.message or "", args.author, (args.tag,) if args.tag else ()))
    elif command == "status":
        out(f"on {repo.branch or repo.detached}")
        rows = repo.staged()
        for r in rows.select("name").orderBy("name").collect() if rows is not None else ():
            out(f"staged {r['name']}")
    elif command == "log":
        for r in repo.log(args.branch, args.number).collect():
            out(f"{r['commit'][:8]} {r['at']:%Y-%m-%d %H:%M:%S} {r['author']} {r['message']}")
    elif command == "checkout":
        repo.checkout(args.target)
        repo.keep_head()
        out(f"on {repo.branch or repo.detached}")
    elif command == "branch":
        if args.name and args.delete:
            repo.delete_branch(args.name)
        elif args.name:
            repo.create_branch(args.name)
        for r in repo.branches().orderBy("name").collect():
            out(f"{'*' if r['current'] else ' '} {r['name']} {r['commit'][:8]}")
    elif command == "merge":
        out(repo.merge(args.branch, strategy=args.strategy, alpha=args.alpha))
    elif command == "diff":
        for r in repo.diff(args.old, args.new).orderBy("name").collect():
            out(f"{r['state']:<10}{r['name']}")
    elif command == "compare":
        for line in report(compare.compare_models(repo.model(args.old), repo.model(args.new))):
            out(line)
    elif command == "tag":
        out(repo.tag(args.name, args.ref, args.description))
    elif command == "show":
        cells = repo.model(args.ref or repo.head(), [args.name]).select(F.col("name").alias("grp"), F.explode("values").alias("x"))
        for r in stats.describe(cells, "grp").collect():
            out(f"{r['grp']}: {r['n']} values, mean {r['mean']:.6g}, std {r['std']:.6g}, {r['low']:.6g} to {r['high']:.6g}")
    elif command == "gc":
        out(f"{repo.collect_garbage(args.remove).count()} objects are named by nothing")
    elif command == "remote":
        if args.action == "add":
            known.add(args.name, args.url)
        elif args.action == "remove":
            known.remove(args.name)
        elif args.action != "list":
            raise ValueError(f"unknown action {args.action}")
        for r in known.list().orderBy("name").collect():
            out(f"{r['name']} {r['url']}")
    elif command in ("push", "pull", "sync-status"):
        row = known.get(args.remote)
        where = row["url"] if row is not None else args.remote
        if command == "sync-status":
            r = repo.sync_status(where).first()
            out(f"ahead {r['ahead']}, behind {r['behind']}, synced {r['synced']}")
        else:
            for r in (repo.push if command == "push" else repo.pull)(where, args.force).collect():
                out(f"{r['moved']} objects, {r['bytes']} bytes")
    elif command == "stats":
        rows = spark.read.parquet(f"{args.repo}/manifests").select("commit", "name", "hash")
        r = store.repository_stats(rows, repo._stored().select("hash", (F.size("values") * 8).cast("long").alias("bytes"))).first()
        out(f"{r['commits']} commits, {r['unique_objects']} objects, {r['duplicates']} repeats, {_bytes(r['bytes'])}")
    elif command == "config":
        settings = config.load(args.repo)
        if args.key and args.value is not None:
            config.set_nested(settings, args.key, args.value)
            wrong = config.check_value(args.key, config.get_nested(settings, args.key))
            if wrong:
                raise ValueError(wrong)
            config.save(settings, f"{args.repo}/config.toml")
        for key in [args.key] if args.key else [f"{s}.{k}" for s, items in settings.to_dict().items() for k in items]:
            out(f"{key} = {config.get_nested(settings, key)}")
    elif command == "publish":
        out("\n".join(tensors.publish(repo.model(args.ref), args.target, args.format, {"ref": args.ref})))


def _bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def report(compared, verbose: bool = False) -> list[str]:
    """A comparison as lines of text; with `verbose` one for each layer, those of another shape included."""
    s = compare.summary(compared).first()
    number = lambda v: "none" if v is None else f"{v:.6f}"
    lines = [f"{s['common']} common layers, {s['only_a']} removed, {s['only_b']} added", f"{s['changed'] or 0} of {s['params'] or 0} values changed", f"similarity {number(s['mean_similarity'])} ({number(s['min_similarity'])} to {number(s['max_similarity'])})"]
    lines += [f"{r['category']}: {r['layers']}" for r in compare.categories(compared).orderBy("category").collect()]
    if verbose:
        lines += [f"{r['name']} {r['status']} {number(r['similarity'])}" for r in compared.orderBy("name").toLocalIterator()]
    return lines


def main() -> int:
    from weftline.session import build_session

    return run(build_session("cli"), sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
