"""Named queries over the driver's tables and their independent SQL oracle."""
