import sys

from linemill.plans.report import main

sys.exit(main())
