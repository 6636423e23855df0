from quarry.cli import main

main()
