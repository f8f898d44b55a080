"""``python -m tideline SCRIPT [CONFIG]``: run a command script and print what it
says; the exit code is 1 if the script or its configuration is in error."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .sources.driver import printed


def main(script: str, config: str | None = None) -> int:
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    failed = False
    try:
        for text, failed in printed(spark, script, config):
            sys.stdout.write(text)
    except ValueError as error:
        sys.stderr.write(f"{error}\n")
        failed = True
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:3]))
