"""DataFrame-to-DataFrame operators over the ``packets`` table and its derivatives."""
