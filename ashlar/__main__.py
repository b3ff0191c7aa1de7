"""python -m ashlar [PATH]: an interactive shell.

SELECT …      the first 10 rows        full SELECT …   all rows
\\c PATH       connect                  \\tables         connections
\\d, \\schema   the columns              \\info           what the source is
\\head          the first rows      \\files, \\chunks  an Iceberg table's entries, a Parquet file's column chunks
\\refresh      look at the files again  help, \\q or exit
"""

from __future__ import annotations

import sys

from ashlar.session import Engine, build_session


def execute(engine: Engine, line: str) -> str | None:
    """What a line gives; None ends the shell."""
    line = line.strip().rstrip(";")
    word, _, rest = line.partition(" ")
    if not line:
        return ""
    if word in ("\\q", "exit", "quit"):
        return None
    try:
        if word in ("help", "\\?"):
            return __doc__ or ""
        if word == "\\c":
            c = engine.connect(rest.strip())
            return f"connected to {c.kind} {c.name}"
        if word in ("\\d", "\\schema"):
            return engine.schema(rest.strip() or None)
        if word == "\\tables":
            return "\n".join(engine.tables())
        if word == "\\info":
            return "\n".join(f"{k}: {v}" for k, v in engine.info(rest.strip() or None).items())
        if word == "\\head":
            return engine.display(engine.preview(rest.strip() or None))
        if word in ("\\files", "\\chunks"):
            return engine.display(engine.inside(rest.strip() or None))
        if word == "\\refresh":
            engine.refresh(rest.strip() or None)
            return "refreshed"
        if word.lower() == "full":
            return engine.show(rest, rows=None)
        return engine.show(line)
    except Exception as e:  # a mistake in a line does not end the shell
        return f"error: {str(e).splitlines()[0]}"


def main() -> None:
    engine = Engine(build_session())
    if len(sys.argv) > 1:
        print(execute(engine, f"\\c {sys.argv[1]}"))
    while True:
        try:
            out = execute(engine, input("ashlar> "))
        except EOFError:
            break
        if out is None:
            break
        print(out)


if __name__ == "__main__":
    main()
