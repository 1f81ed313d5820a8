"""DataFrame transformations over annotation tables."""
