"""Functions on typed values: strings, lists, maps, sets, rankings, bits, JSON, series, vectors and places."""
