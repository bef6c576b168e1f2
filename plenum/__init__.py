"""Learn the conventions of a corpus by voting, then check and fill data against them."""
