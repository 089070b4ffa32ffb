import sys

from quillgraph.engine import main

sys.exit(main())
