import sys

from modgraph.cli import main

sys.exit(main())
