"""Makes the helpers of this folder importable whatever the working directory."""

import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent
for place in (HERE, HERE.parent, HERE.parent.parent):
    if str(place) not in sys.path:
        sys.path.insert(0, str(place))
