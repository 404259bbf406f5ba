from logweave.cli import main

raise SystemExit(main())
