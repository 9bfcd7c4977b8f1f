import sys

from compliq.cli import main

sys.exit(main())
