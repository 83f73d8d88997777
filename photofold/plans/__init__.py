"""Building blocks for plans that stay balanced under skew."""
