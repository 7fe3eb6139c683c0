"""Start of the daily batch for ``spark-submit``; the package goes along as ``--py-files cellwatch.zip``."""

import sys

from cellwatch.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
