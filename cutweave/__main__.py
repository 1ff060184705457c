"""python -m cutweave partition|coarsen|suite ..."""

import sys

from cutweave.plans.commands import main

sys.exit(main())
