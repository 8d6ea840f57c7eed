"""Start a job: ``spark-submit traitloom/__main__.py JOB ...`` or ``python -m traitloom JOB ...``.

Every parameter of the job's function is an option of the same name; ``--help`` lists them.
"""

from __future__ import annotations

import argparse
import inspect
import os
import sys

if __package__ in (None, ""):  # started as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traitloom.plans import jobs  # noqa: E402
from traitloom.session import session  # noqa: E402

JOBS = {
    "matrix": jobs.build_matrix,
    "diff": jobs.diff_matrices,
    "alleles": jobs.summarise_alleles,
    "terms": jobs.expand_terms,
    "attributes": jobs.ontology_attributes,
}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="traitloom", description=__doc__)
    commands = made.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        command = commands.add_parser(name, description=inspect.getdoc(job))
        for option in list(inspect.signature(job).parameters.values())[1:]:
            flag = f"--{option.name.replace('_', '-')}"
            if isinstance(option.default, bool):
                command.add_argument(flag, action=argparse.BooleanOptionalAction, default=option.default)
            else:
                required = option.default is inspect.Parameter.empty
                kind = int if isinstance(option.default, int) else str
                command.add_argument(flag, required=required, type=kind, default=None if required else option.default)
    return made


def main(arguments: list[str] | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    name = options.pop("job")
    result = JOBS[name](session(f"traitloom-{name}"), **options)
    if result is not None:
        for row in result.toLocalIterator():
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
