"""Keeping Python workers small.

Workers live on between tasks, and Spark may start more of them than tasks run at once.  By
default the C library and Arrow keep freed memory for the process; an executor's memory would
then be the sum of all workers' peaks.  Importing this module makes freed buffers of a megabyte
or more go back to the system at once.
"""

import ctypes

import pyarrow as pa

_M_MMAP_THRESHOLD = -3


def give_back(threshold: int = 1 << 20) -> None:
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):  # glibc
        library.mallopt(_M_MMAP_THRESHOLD, threshold)
    pa.set_memory_pool(pa.system_memory_pool())


give_back()
