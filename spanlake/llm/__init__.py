"""Training-data operators: language ID, search, de-duplication, licences, token files, mixing, packing, pages and URLs.

Nothing else in the library imports this subpackage.
"""
