"""Command line: python -m flowspark.run module:flow"""

from __future__ import annotations

import argparse
import ast
import importlib
import os
import sys
from datetime import timedelta

from .runtime import RecoveryConfig, run_main
from .stream import Flow


def locate(text: str) -> tuple[str, str]:
    """Module and expression of "module:expression"; the expression is `flow` by default, and a path to a file is a module too."""
    module, _, expression = text.partition(":")
    if not module:
        raise ValueError("the import string must be module:flow or module:function(arguments)")
    return module.removesuffix(".py").replace(os.sep, "."), expression or "flow"


def load(text: str) -> Flow:
    """The flow that an import string names: a variable, or a call of a function with literal arguments."""
    module, expression = locate(text)
    sys.path.insert(0, os.getcwd())
    found = importlib.import_module(module)
    try:
        node = ast.parse(expression, mode="eval").body
    except SyntaxError:
        raise ValueError(f"{expression!r} is neither a name nor a call") from None
    if isinstance(node, ast.Name):
        got = getattr(found, node.id)
        got = got() if callable(got) and not isinstance(got, Flow) else got
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        try:
            args = [ast.literal_eval(a) for a in node.args]
            kwargs = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        except ValueError:
            raise ValueError(f"arguments in {expression!r} must be literals") from None
        got = getattr(found, node.func.id)(*args, **kwargs)
    else:
        raise ValueError(f"{expression!r} is neither a name nor a call")
    if not isinstance(got, Flow):
        raise TypeError(f"{text!r} is a {type(got).__name__}, not a Flow")
    return got


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="flowspark.run", description="Run a flow on the session that spark-submit or the environment configures.")
    out.add_argument("import_str", help="module:flow")
    env = os.environ.get
    out.add_argument("-r", "--recovery-directory", default=env("FLOWSPARK_RECOVERY_DIRECTORY"))
    out.add_argument("-s", "--snapshot-interval", type=float, default=env("FLOWSPARK_SNAPSHOT_INTERVAL"), help="seconds in an epoch")
    out.add_argument("-b", "--backup-interval", type=float, default=env("FLOWSPARK_BACKUP_INTERVAL"), help="seconds for which older snapshots are kept")
    out.add_argument("--available-now", action="store_true", help="stop once what is there now has been read")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    recovery = None
    if args.recovery_directory:
        if args.snapshot_interval is None or args.backup_interval is None:
            parser().error("-r needs -s and -b")
        recovery = RecoveryConfig(args.recovery_directory, max(2, round(float(args.backup_interval) / max(float(args.snapshot_interval), 0.1)) + 1))
    epoch = timedelta(seconds=float(args.snapshot_interval)) if args.snapshot_interval is not None else None
    run_main(load(args.import_str), epoch_interval=epoch, recovery_config=recovery, available_now=args.available_now)


if __name__ == "__main__":
    main()
