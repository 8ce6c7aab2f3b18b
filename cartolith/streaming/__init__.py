"""The same operators over directories that grow."""
