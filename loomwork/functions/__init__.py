from loomwork.functions.batched import is_prime, pair_lcs  # noqa: F401
from loomwork.functions.scalars import *  # noqa: F401,F403
