"""DataFrame operators of the media library."""
