"""Rules of the extraction domains: validation, compilation and their joins with texts."""
