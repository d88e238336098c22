"""Training-data operators: packing, extraction, filters, de-duplication, decontamination, sharding, chat.

Nothing outside this subpackage imports it.
"""
