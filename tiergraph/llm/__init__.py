"""Training-data operators: tokens, decontamination, fixity, quality, dedup, packing, sharding.

Nothing outside this subpackage imports it; ``queries`` holds the driver-facing queries.
"""
