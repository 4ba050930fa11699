"""python -m driftline detect|run|doctor|eval ..."""

import sys

from .plans.api import main

sys.exit(main())
